"""Pareto mixing, incremental whitening and periodic runs against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk.llm import mixing, packing, periodic_runs, queries, sharding, whitening
from tests.test_queries import rows as table_rows

WORD = re.compile(r"[^ \t-\r]+")
ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t", None), (4, "same text here", "a"), (4, "same text here", "a"), (None, "x y z", None), (5, "é " * 9_000, "b"), (None, None, None), (2**60 + 1, "one", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return docs.selectExpr("*", "1 as size", "'clash' as target", "2 as row", "3 as class", "4 as key", "5 as runs", "6 as n_words")


# Mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, what is above a cap shared again, until none is."""
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in capped]
        rest = total - sum(capped.values())
        share = {n: rest * weight[n] / sum(weight[x] for x in free) for n in free}
        above = [n for n in free if share[n] > most * sizes[n]]
        if not above:
            return capped | share
        capped |= {n: most * sizes[n] for n in above}


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé", min_size=1, max_size=2)), st.integers(0, 2_000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").coalesce(1)
    out = {r["source"]: r["target"] for r in mixing.targets(df, (1, 2, 3), 3).collect()}
    want = brute_targets(sizes)
    assert out.keys() == want.keys() and all(math.isclose(out[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def mixture(rng, n=1_500):
    lengths = lambda: rng.choice([0, 1, 5, 30, 31, 200, rng.randrange(1, 900)])
    out = [(i, " ".join(["w"] * lengths()), rng.choices(["a", "b", "c", None, "tiny"], [60, 20, 10, 9, 1])[0]) for i in range(n)]
    return out + [(None, "again and again", "a")] * 700 + [(7, "same id", "b")] * 90


def check_mix(found, docs):
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((i, size(t), s) for i, t, s in docs) == Counter((r["doc_id"], r["size"], r["source"]) for r in found)
    of_source, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        of_source[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    want = brute_targets(of_source)
    for r in found:
        assert r["source_size"] == of_source[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
    for s in of_source:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


@pytest.mark.parametrize("ranges", [1 << 16, 4])
def test_mix_meets_targets(spark, monkeypatch, ranges):
    """Also with a few ranges only, where many rows share one, and reruns over other partitions agree."""
    monkeypatch.setattr(mixing, "RANGES", ranges)
    docs = mixture(random.Random(11))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = mixing.mix(df.repartition(5)).collect()
    check_mix(found, docs)
    again = mixing.mix(df.repartition(3, "text")).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_mix_by_sql(spark):
    """The same rows as the SQL, where ties and nulls abound."""
    df = spark.createDataFrame(mixture(random.Random(2), 800), "doc_id long, text string, source string")
    link = duckdb.connect()
    documents = df.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    link.register("documents", documents)
    out = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert table_rows(out) == table_rows(link.sql(queries.ORACLE_SQL["op12_pareto_mixing"]).df())


def test_mix_samples_by_odds(spark):
    """Over many seeds a document's copies come near what is expected, and longer documents are likelier."""
    docs = [(i, " ".join(["w"] * (3 if i % 2 else 40)), "a" if i % 4 < 2 else "b") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    sums = Counter()
    for seed in range(12):
        for r in mixing.mix(df, seed=f"s{seed}").collect():
            sums[r["source"], r["size"]] += r["copies"] / (12 * 20)
    for s in "ab":
        assert sums[s, 40] > sums[s, 3]
    expected = {(r["source"], r["size"]): r["m"] for r in _expected(spark, df)}
    assert all(abs(sums[k] - m) <= 0.15 for k, m in expected.items())


def _expected(spark, df):
    sized = df.select("source", F.regexp_count("text", F.lit(r"\S+")).alias("size")).withColumn("class", F.length(F.bin("size")).cast("long"))
    sources = mixing.targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), (1, 2, 3), 3)
    classes = sized.groupBy("source", "size", "class").agg(F.sum("size").cast("long").alias("words")).join(sources, "source").withColumn("stratum", F.col("source"))
    plan = mixing.copies(classes, 3)
    return plan.select("source", "size", (F.col("whole") + F.col("chance")).alias("m")).collect()


def test_mix_odd_rows(spark, odd):
    found = mixing.mix(odd, carry=["text"]).collect()
    check_mix(found, ODD)
    assert all(r["taken"] == 0 for r in found if not WORD.search(r["text"] or ""))
    assert mixing.mix(odd.limit(0)).count() == 0
    only = mixing.mix(odd.where("text is null")).collect()
    assert len(only) == 2 and all((r["source_size"], r["target"], r["taken"]) == (0, 0.0, 0) for r in only)


# Whitening


def spectrum_of(x, parts):
    out = whitening.empty_spectrum(x.shape[1])
    for part in np.array_split(x, parts):
        s = whitening.empty_spectrum(x.shape[1])
        for row in part:
            s = whitening.with_vector(s, row)
        out = whitening.combined(out, s)
    return out


@pytest.mark.parametrize(("kind", "parts"), [("wide", 1), ("wide", 7), ("repeated", 3), ("bits", 5), ("decaying", 4), ("few", 2), ("constant", 3), ("one", 2)])
def test_spectrum_before_refinement(kind, parts):
    """Rank-one updates alone give the eigenvalues and an orthonormal basis of the scatter."""
    rng = np.random.default_rng(parts)
    x = {
        "wide": lambda: rng.normal(size=(400, 12)) * 100, "repeated": lambda: np.repeat(rng.normal(size=(9, 8)) * 500, 20, 0), "bits": lambda: rng.integers(0, 2, (300, 6)),
        "decaying": lambda: rng.normal(size=(300, 20)) @ np.diag(10.0 ** -np.arange(0, 5, 0.25)) * 1e5, "few": lambda: rng.normal(size=(5, 16)) * 100,
        "constant": lambda: np.ones((40, 7)) * 3, "one": lambda: rng.normal(size=(50, 1)) * 30,
    }[kind]()
    x = np.floor(x).astype(np.int64) + whitening.SHIFT
    n, total, values, vectors = spectrum_of(x, parts)
    y = x - x.mean(0)
    scatter, scale = y.T @ y, max(1.0, np.abs(y.T @ y).max())
    assert n == len(x) and (total == x.sum(0)).all()
    assert np.abs(vectors.T @ vectors - np.eye(x.shape[1])).max() < 1e-10
    assert np.abs(vectors @ np.diag(values) @ vectors.T - scatter).max() < 1e-9 * scale
    assert np.abs(values - np.linalg.eigvalsh(scatter)).max() < 1e-9 * scale


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=9), st.data())
def test_rank_one(values, data):
    """Poles that coincide or nearly do, and directions without any part, are deflated."""
    d = len(values)
    v = np.array(data.draw(st.lists(st.one_of(st.just(0.0), st.floats(-1e3, 1e3)), min_size=d, max_size=d)))
    values = np.sort(np.array(values))
    vectors = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    want = vectors @ np.diag(values) @ vectors.T + np.outer(v, v)
    got, basis = whitening.rank_one(values, vectors, v)
    scale = max(1.0, np.abs(want).max())
    assert np.abs(basis @ np.diag(got) @ basis.T - want).max() < 1e-11 * scale * d and np.abs(basis.T @ basis - np.eye(d)).max() < 1e-10


def test_whitened_rows(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10))).astype(np.float32)
    data = [(i if i != 4 else None, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0, None] + [0.0] * 8), (902, [float("nan")] * 10), (903, [float("inf")] + [0.0] * 9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "'x' as component", "2 as vector").repartition(20)
    out = whitening.whiten(df).toPandas()
    whole = np.floor(1024 * x.astype(float)).astype(np.int64) + 100_000
    y = whole - whole.mean(0)
    values, vectors = np.linalg.eigh(y.T @ y / 300)
    assert len(out) == 300 * 8 and set(out["n"]) == {300} and out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    deviation = ((300 * whole - whole.sum(0)) ** 2).sum(1)
    known = out[out["vec_id"].notna()]
    for c in range(1, 9):
        part = known[known["component"] == c].set_index("vec_id").sort_index()
        ids = part.index.astype(int)
        want = (y @ vectors[:, -c] / np.sqrt(values[-c]))[ids]
        assert min(np.abs(part["whitened"] - want).max(), np.abs(part["whitened"] + want).max()) < 1e-8
        assert np.allclose(part["explained"], values[-c] / values.sum(), rtol=1e-10) and (part["deviation"].to_numpy() == deviation[ids]).all()


def test_whiten_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None), (2, [])])).count() == 0
    same = whitening.whiten(make([(i, [0.5, 0.25, 1.0]) for i in range(6)])).collect()
    assert len(same) == 18 and all((r["whitened"], r["explained"], r["deviation"], r["identity_error"]) == (0.0, 0.0, 0, 0.0) for r in same)
    few = whitening.whiten(make([(1, [1.0, 0.0]), (2, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 2.0]), (3, [])])).toPandas()  # shorter vectors end in zeros
    assert len(few) == 12 and few["identity_error"].iloc[0] < 1e-9 and math.isclose(few.drop_duplicates("component")["explained"].sum(), 1)
    with pytest.raises(Exception, match="64 bits|whole numbers"):
        whitening.whiten(make([(1, [1e300]), (2, [0.0])])).collect()


# Periodic runs


def brute_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            w = words[s : i + q]
            if len(w) >= max(6, 4 * q) and not any(w[d:] == w[:-d] for d in range(1, q)):
                out.add((s, len(w), q))
    return sorted(out)


def repetitive(rng):
    words = []
    while rng.random() < 0.85:
        words += [rng.choice("abc") for _ in range(rng.randint(1, 4))] * rng.randint(1, 7) if rng.random() < 0.5 else [rng.choice("abcdef")]
    return words


def test_runs_by_brute_force():
    rng = random.Random(6)
    for _ in range(1_500):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 4))]
        for words, found in zip(texts, periodic_runs.runs_of(texts), strict=True):
            assert found == brute_runs(words), words


@pytest.mark.parametrize("words", [["a"] * 5, ["a"] * 6, ["a"] * 3_000, list("ab" * 900), list("abaab" * 200 + "abaab"[:3]), list("xy" + "abc" * 4), list("abcabcabcab"), []])
def test_long_and_short_runs(words):
    assert periodic_runs.runs_of([words, ["z"], words]) == [brute_runs(words), [], brute_runs(words)]


def test_runs_take_time_with_length():
    """A long text over two words: nowhere near the square of its length."""
    rng = random.Random(1)
    words = [rng.choice("ab") for _ in range(60_000)]
    assert len(periodic_runs.runs_of([words])[0]) > 100


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_run_rows(spark, odd, tmp_path):
    rng = random.Random(9)
    docs = [(i, " ".join(repetitive(rng) + rng.choices("abcdefghijk", k=rng.randrange(40)))) for i in range(300)] + [(i, t) for i, t, _ in ODD if len(t or "") < 100]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    out = Counter(tuple(r[c] for c in columns) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert out == Counter(brute_row(*x) for x in docs)
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(odd.where("doc_id is not null")).collect()}
    assert found[5]["kept_text"] == "é" and [tuple(r) for r in found[5]["runs"]] == [(0, 9_000, 1)] and found[2**60 + 1]["n_words"] == 1
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0


@pytest.mark.parametrize("chars", [1, 50, 1_000_000])
def test_groups_of_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(periodic_runs, "GROUP_CHARS", chars)
    docs = spark.createDataFrame([(i, "a b " * (i % 9)) for i in range(60)], "doc_id long, text string").coalesce(2)
    assert {r["doc_id"]: len(r["runs"]) for r in periodic_runs.find_runs(docs).collect()} == {i: int(i % 9 >= 4) for i in range(60)}


# Rows that are alike in every column


def spread(df, key):
    return sorted(df.groupBy(*key).count().toPandas()["count"])


def test_alike_rows_are_dealt(spark, monkeypatch):
    """A third of all rows null in id and text: shards stay right, and no ordering takes them all."""
    docs = spark.createDataFrame([(None, None, "a")] * 3_000 + [(i, f"text {i}", "ab"[i % 2]) for i in range(6_000)], "doc_id long, text string, source string").repartition(6)
    out = sharding.interleave_shards(docs, n_shards=7, rows_per_bucket=50)
    assert spread(out, ["shard"]) == [1285, 1285, 1286, 1286, 1286, 1286, 1286]
    assert all(abs(n - 6_000 / 7) <= 2 for n in out.where("source = 'a'").groupBy("shard").count().toPandas()["count"])  # every shard matches the mixture
    assert out.groupBy("shard", "slot").count().where("count > 1").count() == 0
    packed = packing.pack(docs.limit(9_000), rows_per_bucket=50)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" in plan
    by_sequence = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("places"), F.count("*").alias("pieces")).toPandas()
    assert (by_sequence["n"] <= 2048).all() and (by_sequence["places"] == by_sequence["pieces"]).all() and by_sequence["pieces"].sum() == 9_000
