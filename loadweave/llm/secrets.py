"""Secret scans: strong patterns by themselves, weak parts only where their complements stand nearby.

Strong patterns are reported wherever they match. Weak parts (a long opaque key, an address of
a service) are everyday text by themselves. They are reported only when linked: a key needs an
access identifier or a credential assignment in its scope, an address needs an identifier or
an assignment. Parts are linked by an interval join on (document, stretch of `SCOPE` code points):
each weak part asks in its own stretch and in the two beside it, and the distance decides. Weak parts that
overlap a strong one are found by the same join and left out.

Everything is built-in expressions. Positions come from the lengths of the pieces between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.common import let, stored, version, whole

#: Code points between two parts that belong together
SCOPE = 200

#: Fixed base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: a run shorter than the least length holds no match that starts later and is long enough
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts
KEY = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"

#: Matches whose places are summed up together
BLOCK = 128

_SPAN = "array<struct<kind:string,start:int,end:int>>"


def _sums_before(sizes: Column) -> Column:
    """For each element the sum of those before it, block by block, so that a text of very many matches takes no quadratic time."""

    def blocks(x: Column) -> Column:
        count = F.ceil(F.size(x) / F.lit(BLOCK)).cast("int")
        return F.when(count < 1, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(1), count), lambda b: F.slice(x, (b - 1) * BLOCK + 1, F.lit(BLOCK))))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)

    def inside(block: Column) -> Column:
        return F.transform(block, lambda v, i: total(F.slice(block, F.lit(1), i)))

    def placed(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        offsets = F.aggregate(parts, start, lambda acc, b: F.struct((acc["at"] + total(b)).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")))["found"]
        return F.flatten(F.zip_with(parts, offsets, lambda b, o: F.transform(inside(b), lambda v: v + o)))

    return let(sizes, lambda x: let(blocks(x), placed))


def spans(text: Column, kind: str, pattern: str, least: tuple[int, int] = (0, 1)) -> Column:
    """The pattern's leftmost non-overlapping matches whose group `least[0]` has at least `least[1]` code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    asked = F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0]))
    gaps = F.split(text, pattern, -1)

    def found(m: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        ends = F.zip_with(_sums_before(sizes), sizes, lambda before, own: before + own)
        placed = F.zip_with(ends, F.arrays_zip(m.alias("m"), asked.alias("a")), lambda end, x: F.struct(F.lit(kind).alias("kind"), (end - F.length(x["m"])).alias("start"), end.alias("end"), F.length(x["a"]).alias("asked")))
        return F.transform(F.filter(placed, lambda s: s["asked"] >= least[1]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    none = F.array().cast(_SPAN)
    return F.when(text.rlike(pattern), let(matches, found).cast(_SPAN)).otherwise(none)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ("assign", "access", "hex", "key", "endpoint"))), kind)


def digest_form(found: Column) -> Column:
    """kind:start:end by start, then kind in the order of the list above, comma-joined."""
    order = F.transform(found, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: (doc_id, base, linked); lists of (kind, start, end) in code points, end exclusive.

    `base` has the strong matches (assign, access, hex), `linked` the weak ones (key, endpoint) that have a
    complement within `scope` code points: an access identifier or an assignment. A key inside a base match is
    part of it and not reported again.

    Defined cases: null and empty texts have no spans; equal starts come in the order of the kinds; rows that
    repeat come out as often; rows of one doc_id with different texts have the spans of their own; a row without a doc_id has base spans and no linked
    ones; other columns are ignored; no rows give no rows.
    """
    text = whole("body")
    base = F.concat(spans(text, "assign", ASSIGN, (2, 6)), spans(text, "access", ACCESS), spans(text, "hex", HEX))
    weak = F.concat(spans(text, "key", KEY), spans(text, "endpoint", ENDPOINT))
    found = docs.select("doc_id", version().alias("version"), whole(docs["text"]).alias("body")).select("doc_id", "version", base.alias("base"), weak.alias("weak"))
    # without a strong part there is nothing to link to
    found = stored(found.withColumn("weak", F.when(F.size("base") > 0, F.col("weak")).otherwise(F.array().cast(_SPAN))))
    strong = found.select("doc_id", "version", F.explode("base").alias("s")).select("doc_id", "version", F.col("s.kind").alias("strong"), F.col("s.start").alias("from"), F.col("s.end").alias("to")).distinct()
    weak = stored(found.select("doc_id", "version", F.explode("weak").alias("s")).select("doc_id", "version", "s.*").distinct())
    held = strong.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / scope), F.floor(F.col("to") / scope))))

    def meeting(margin: int, kinds: tuple[str, ...]) -> DataFrame:
        """The weak spans with a strong one of these kinds within the margin: they share a stretch of the text, which has few of either."""
        asked = weak.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - margin) / scope), F.floor((F.col("end") + margin) / scope))))
        near = (F.col("from") <= F.col("end") + margin) & (F.col("start") <= F.col("to") + margin) if margin else (F.col("from") < F.col("end")) & (F.col("start") < F.col("to"))
        which = held.where(F.col("strong").isin(*kinds))
        same = [asked[c] == which[c] for c in ("doc_id", "version", "cell")]
        return asked.join(which, on=[*same, near], how="left_semi").select("doc_id", "version", "kind", "start", "end").distinct()

    # a weak part inside a strong one is the strong one
    linked = meeting(scope, ("assign", "access")).join(meeting(0, ("assign", "access", "hex")), ["doc_id", "version", "kind", "start", "end"], "left_anti")
    per_doc = linked.groupBy("doc_id", "version").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    return found.select("doc_id", "version", "base").join(per_doc, ["doc_id", "version"], "left").select("doc_id", "base", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))
