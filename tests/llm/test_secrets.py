"""Secret scans against the re module."""

from __future__ import annotations

import time
import hashlib
import random
import re

from pyspark.sql import functions as F

from loadweave.llm import queries, secrets
from tests.conftest import SF
from tests.llm.frames import by_id, frame, odd_rows, prose

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KINDS = ("assign", "access", "hex", "key", "endpoint")


def base(text):
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def linked(text):
    text, strong = text or "", base(text)
    weak = [("key", *m.span()) for m in re.finditer(r"[A-Za-z0-9+/]{32,}", text)] + [("endpoint", *m.span()) for m in re.finditer(r"https?://[A-Za-z0-9.-]+", text)]
    weak = [w for w in weak if not any(b[1] < w[2] and w[1] < b[2] for b in strong)]
    return sorted(w for w in weak if any(k != "hex" and a <= w[2] + 200 and w[1] <= b + 200 for k, a, b in strong))


def spans(found):
    return [(s["kind"], s["start"], s["end"]) for s in found]


def check(spark, rows):
    out = by_id(secrets.secrets(frame(spark, rows)), "base", "linked")
    assert sum(map(len, out.values())) == len(rows)
    for doc_id, text in rows:
        got = [(sorted(spans(b), key=lambda s: (s[1], KINDS.index(s[0]))), sorted(spans(w))) for b, w in out[doc_id]]
        assert (base(text), linked(text) if doc_id is not None else []) in got


def secret_text(seed):
    rnd = random.Random(seed)
    parts = ["password=abc", 'Token: "abcdefgh"', "API_KEY = x.y.z-1", "apikey:'", "secret: token: abcdef12", "AKIA" + "Z9" * 8, "AKIA12", "AKIAAKIA" + "Q" * 14, "ab12" * 7, "é😀", "deadbeef" * 3, "Q1w" * 13, "https://api.example.org/x", "http://h", "token = " + "0f" * 20]
    return " ".join(rnd.choice(parts) if rnd.random() < 0.4 else prose(rnd.randrange(99), rnd.choice([1, 5, 30])) for _ in range(rnd.randint(1, 14)))


def test_random_texts(spark):
    check(spark, [(i, secret_text(i)) for i in range(150)])


def test_odd_rows(spark):
    check(spark, odd_rows() + [(30, "password=secret12"), (30, "password=secret12"), (None, "token=abcdefgh " + "Qw1" * 12)])


def test_weak_parts_need_a_complement(spark):
    key = "Qw1Er2Ty3" * 4
    rows = [(1, key), (2, f"AKIA{'X' * 16} {key}"), (3, f"AKIA{'X' * 16} {prose(1, 90)} {key}"), (4, f"{'0a' * 12} {key}"), (5, f"{key} https://host.example password=hunter22")]
    out = by_id(secrets.secrets(frame(spark, rows)), "linked")
    assert {i: [s["kind"] for s in v[0][0]] for i, v in out.items()} == {1: [], 2: ["key"], 3: [], 4: [], 5: ["key", "endpoint"]} or sorted(s["kind"] for s in out[5][0][0]) == ["endpoint", "key"]
    assert not out[1][0][0] and out[2][0][0] and not out[3][0][0] and not out[4][0][0]


def test_no_rows(spark):
    assert secrets.secrets(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = secrets.secrets(frame(spark, [(1, "a")])).withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = base(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for x, _, _ in found) for k in KINDS[:3]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def test_many_pairs_in_one_text_take_seconds(spark):
    n = 20_000
    text = " ".join(f"token=abcdef{i:05d} https://h{i}.example.org" for i in range(n))
    start = time.perf_counter()
    (row,) = secrets.secrets(frame(spark, [(1, text)])).select(F.size("base"), F.size("linked")).collect()
    assert tuple(row) == (n, n) and time.perf_counter() - start < 120


def test_rows_of_one_id_keep_their_own_spans(spark):
    a, b = "token=abcdefgh " + "Q1w" * 13, "nothing here " + "Q1w" * 13
    check(spark, [(1, a), (1, b), (2, b)])
    assert {tuple(r) for r in secrets.secrets(frame(spark, [(1, a), (1, b)])).select(F.size("linked")).collect()} == {(1,), (0,)}
