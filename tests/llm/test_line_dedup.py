"""Line deduplication against counting in Python."""

from __future__ import annotations

import random
from collections import defaultdict

from loadweave.llm import line_dedup
from loadweave.llm.line_dedup import LineRuns
from tests.llm.frames import by_id, frame, odd_rows, prose


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def expected(rows):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders[key(x)]) < 3 or len(key(x)) < 20 or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(map(tuple, line_dedup.line_dedup(df, **options).collect()), key=repr)


def test_random_documents(spark):
    rnd = random.Random(3)
    pool = [prose(i, 5) for i in range(12)] + ["  Short\t", "", "Ünïcode line that is long enough ÄÖ", "exactly twenty chars"]
    rows = [(i, "\n".join(rnd.choice(["", " ", "\t\r"]) + rnd.choice(pool).title() + rnd.choice(["", "  "]) for _ in range(rnd.randint(0, 9)))) for i in range(80)]
    assert got(frame(spark, rows)) == expected(rows)


def test_odd_rows(spark):
    rows = odd_rows() + [(20 + i, "A line that very many documents hold\nown line of mine number %d" % i) for i in range(5)]
    assert got(frame(spark, rows)) == expected(rows)


def test_every_line_lost_leaves_the_empty_text(spark):
    rows = [(i, "the same line in all of them") for i in range(4)]
    assert got(frame(spark, rows)) == expected(rows)


def test_no_rows(spark):
    assert got(frame(spark, [])) == []


def test_more_batches_give_the_same(spark):
    rows = [(i, "\n".join(prose(j, 5) for j in range(i % 7))) for i in range(40)]
    assert got(frame(spark, rows), batches=7) == expected(rows)


def test_runs_are_levelled_and_tell_new_keys(spark):
    runs, seen = LineRuns(fanout=2), set()
    for number in range(5):
        keys = [bytes([k]) for k in range(number, number + 4)]
        batch = spark.createDataFrame([(bytearray(k), 1, 100 - number) for k in keys], "key binary, n_docs long, last_id long")
        new = {bytes(r["key"]) for r in runs.add(batch).collect()}
        assert new == set(keys) - seen
        seen |= set(keys)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    total = {bytes(r["key"]): (r["n_docs"], r["owner"]) for r in LineRuns.merged(runs.all()).collect()}
    assert total[bytes([3])] == (4, 100) and total[bytes([7])] == (1, 96)


def test_repeated_id_with_another_shorter_text(spark):
    line = "a line that three documents have"
    own = [f"a line of its own, number {i:02d}" for i in range(6)]
    rows = [(1, "\n".join([*own[:5], line])), (1, own[5]), (2, line), (3, line)]
    out = by_id(line_dedup.line_dedup(frame(spark, rows)), "n_lines", "n_dropped", "kept_text")
    assert sorted(out[1]) == [(1, 0, own[5]), (6, 1, "\n".join(own[:5]))]
    assert out[2] == [(1, 1, "")] and out[3] == [(1, 0, line)]
