"""Quality rules, classifier, language, sharding, packing: brute force, held-out accuracy, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarisk.llm import language, packing, quality_classifier, quality_rules, sharding
from tamarisk.llm.textstats import base_counts

WORD = re.compile(r"[^ \t-\r]+")
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t", None, None), (4, "same text here", "en", "a"), (4, "same text here", "en", "a"), (None, "x y z", "fr", None), (5, "é" * 50_000, "fr", "b"), (6, "12 34 !!", "en", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return docs.selectExpr("*", "1 as n_words", "'clash' as score", "'clash' as shard", "'clash' as length")


def brute_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab#|\n \t é", max_size=60))
def test_base_counts(text):
    assert base_counts(text, WORD.findall(text), text.split("\n")) == brute_counts(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.floats(-3, 3), max_size=6), max_size=3), st.floats(0, 1), st.floats(-1, 0))
def test_content_lines(texts, stay, leave):
    """The best of all labellings, for many texts side by side."""
    path = quality_rules.content_lines(np.array([x for t in texts for x in t]), np.array([len(t) for t in texts], dtype=np.int64), stay, leave).astype(int)
    low = 0
    for scores in texts:
        value = lambda p: sum(s * x for s, x in zip(scores, p)) + sum(stay if a == b else leave for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max((value(p) for p in np.ndindex(*[2] * len(scores))), default=0)
        assert abs(value(path[low : low + len(scores)]) - best) < 1e-9
        low += len(scores)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(4)
    scores, stay, leave = rng.normal(size=(3, 4)), 0.7, -0.4
    mask = np.arange(4) < np.array([[4], [2], [1]])
    _, alpha, beta, total = quality_rules.forward_backward(scores, mask, stay, leave)
    for i, n in enumerate((4, 2, 1)):
        paths = list(np.ndindex(*[2] * n))
        weight = np.exp([sum(scores[i, t] * x for t, x in enumerate(p)) + sum(stay if a == b else leave for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(total[i], np.log(weight.sum()))
        for t in range(n):
            assert np.isclose(np.exp(alpha[i, t, 1] + beta[i, t, 1] - total[i]), sum(w for w, p in zip(weight, paths) if p[t]) / weight.sum())


def test_quality_rules_odd_rows(spark, odd):
    model = quality_rules.train([])
    out = quality_rules.apply_rules(odd, model).collect()
    assert len(out) == len(ODD)
    assert all(r["base_failed"] and not r["kept"] for r in out)
    assert quality_rules.apply_rules(odd.limit(0), model).count() == 0


NOUNS = "river farmer harbour mill lesson garden letter winter village engine question market window teacher bridge".split()
VERBS = "carried watched repaired described remembered crossed painted followed opened measured".split()
FURNITURE = [
    "Home | About | Contact", "Share this article", "Cookie policy", "Subscribe to our newsletter", "Read more »", "© 2021 Example Media. All rights reserved.",
    "Posted on 12 March 2020", "Related posts", "Privacy Policy · Terms of Service", "Next page", "Comments (12)", "Menu", "LOG IN", "www.example.com/news",
]


def prose(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} a {rng.choice(NOUNS)} of the {rng.choice(NOUNS)}, and in the {rng.choice(NOUNS)} it {rng.choice(VERBS)} the old {rng.choice(NOUNS)}."


def junk(rng):
    return " ".join(rng.choice(NOUNS).upper() + rng.choice(["!!", "###", "$$$", " |"]) for _ in range(rng.randint(3, 9)))


@pytest.fixture(scope="module")
def rules():
    rng = random.Random(2)
    sample = [("\n".join(prose(rng) for _ in range(rng.randint(1, 20))), 1) for _ in range(150)]
    return quality_rules.train(sample + [("\n".join(junk(rng) for _ in range(rng.randint(1, 20))), 0) for _ in range(60)])


def labels_of(lines, model):
    feats = quality_rules.lines_of("\n".join(lines))[1]
    return quality_rules.content_lines(feats @ model[0], np.array([len(feats)]), *model[1:]).astype(int).tolist()


@pytest.mark.parametrize("runs", [[(1, 10), (0, 10)], [(1, 6), (0, 3), (1, 6)], [(0, 2), (1, 20)]])
def test_mixed_documents(rules, runs):
    rng = random.Random(9)
    lines = [(prose if kind else junk)(rng) for kind, n in runs for _ in range(n)]
    assert labels_of(lines, rules) == [kind for kind, n in runs for _ in range(n)]


def test_furniture_in_prose(rules):
    rng, right, total = random.Random(3), 0, 0
    for _ in range(60):
        lines = [(prose(rng), 1) for _ in range(12)]
        for _ in range(3):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = [(x, 0) for x in rng.sample(FURNITURE, rng.randint(1, 3))]
        right += sum(a == b for a, (_, b) in zip(labels_of([x for x, _ in lines], rules), lines))
        total += len(lines)
    assert right >= 0.9 * total


def test_quality_rules_fit_long_text(spark):
    """Long texts reach training by their segments, and are labelled whole."""
    rng = random.Random(6)
    rows = [(i, "\n".join((prose if i % 2 else junk)(rng) for _ in range(200 if i < 4 else 5)), i % 2) for i in range(24)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").selectExpr("*", "'x' as quality", "1 as kept")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_rules.fit(docs, labels)
    long = docs.limit(0).select("doc_id", "text").union(spark.createDataFrame([(1, "\n".join([prose(rng) for _ in range(3000)] + [junk(rng) for _ in range(1000)]))], "doc_id long, text string"))
    row = quality_rules.apply_rules(long, model, lines=True).first()
    assert row["n_lines"] == 4000 and row["line_labels"][:3000].count(1) > 2900 and row["line_labels"][3000:].count(0) > 950
    assert quality_rules.fit(docs.limit(0), labels)[1:] == (quality_rules.STAY, quality_rules.LEAVE)


def test_trees_separate_and_handle_one_class():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    trees = quality_classifier.grow(x[:400], y[:400])
    assert ((quality_classifier.walk(trees, x[400:]) > 0.5) == y[400:]).mean() > 0.93
    flat = quality_classifier.grow(x[:10], np.ones(10))
    assert quality_classifier.walk(flat, x[:2]).shape == (2,)


def plain_walk(trees, row):
    total = trees.prior
    for at in trees.roots:
        while trees.feature[at] >= 0:
            at = trees.left[at] + int(row[trees.feature[at]] > trees.threshold[at])
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_by_plain_walk():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)  # with ties
    trees = quality_classifier.grow(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int), n_trees=25)
    assert np.allclose(quality_classifier.walk(trees, x), [plain_walk(trees, row) for row in x])


def test_first_split_is_the_best_of_all():
    """The histogram split of one tree of depth one has the highest gain of all cuts between values."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 20, size=(200, 3)).astype(float), rng.integers(0, 2, 200)
    y[x[:, 1] > 12] = 1
    trees = quality_classifier.grow(x, y, n_trees=1, depth=1)
    share = y.mean()
    gradient, weight = y - share, np.full(len(y), share * (1 - share))

    def gain(low):
        sides = [(gradient[m].sum(), weight[m].sum()) for m in (low, ~low)]
        return sum(g * g / (h + 1) for g, h in sides) - gradient.sum() ** 2 / (weight.sum() + 1)

    cuts = {(j, c): gain(x[:, j] <= c) for j in range(3) for c in np.unique(x[:, j])[:-1] if 10 <= (x[:, j] <= c).sum() <= len(x) - 10}
    found = gain(x[:, trees.feature[0]] <= trees.threshold[0])
    assert np.isclose(found, max(cuts.values()))


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    learned = "crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"
    trees = quality_classifier.fit(docs.selectExpr("doc_id as id", "text as body", "'x' as quality"), labels.where(learned), id_col="id", text_col="body")
    rest = quality_classifier.score(docs, trees).join(labels.where(f"not {learned}"), "doc_id").collect()
    assert len(rest) > 30 and sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rest) >= 0.95 * len(rest)


def test_classifier_odd_rows(spark, odd):
    trees = quality_classifier.grow(np.zeros((0, len(quality_classifier.STATS))), np.zeros(0))
    out = quality_classifier.score(odd, trees).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.score(odd.limit(0), trees).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=4), st.integers(2, 3), st.integers(0, 99))
def test_best_paths(lengths, k, seed):
    scores = np.random.default_rng(seed).normal(size=(sum(lengths), k)).astype(np.float32)
    path = language.best_paths(scores, np.array(lengths), 0.7)
    low = 0
    for n in lengths:
        own = scores[low : low + n]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max((value(p) for p in np.ndindex(*[k] * n)), default=0)
        assert abs(value(path[low : low + n]) - best) < 1e-4
        low += n


def test_language_spans_and_odd_rows(spark, odd):
    train = [("en", "the cat and the dog went to the house with that other one"), ("fr", "le chat et le chien sont dans la maison avec une autre"), ("ru", "кошка и собака пошли в дом")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(train * 5)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    mixed = spark.createDataFrame([(1, "the dog and the cat went there le chien et la maison avec le chat"), (2, "собака")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language.identify(mixed, model, penalty=2.0, spans=True).collect()}
    assert [s["lang"] for s in out[1]["spans"]] == ["en", "fr"] and out[2]["lang_pred"] == "ru"
    found = language.identify(odd, model, carry=("source", "text")).collect()
    assert len(found) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3, 6)} == dict.fromkeys((1, 2, 3, 6), "und")
    assert language.identify(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))
    rest = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    out = language.identify(rest, model, carry=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_shards(spark, odd):
    docs = spark.range(1000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source")
    out = sharding.interleave_shards(docs, 13, rows_per_bucket=40).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 13
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    by_source = out.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (by_source.max(axis=1) - by_source.min(axis=1)).max() <= 2
    assert out.set_index("doc_id").loc[7, "text_crc32"] == zlib.crc32(b"x" * 7)
    found = sharding.interleave_shards(odd, 3).collect()
    assert len(found) == len(ODD) and {r["size"] for r in found if r["doc_id"] == 5} == {100_016}
    assert sharding.interleave_shards(odd.limit(0), 3).count() == 0


def test_shards_of_rows_without_an_id(spark):
    """They are shuffled by their texts, repeated rows tie, and every law holds as before."""
    docs = spark.range(600).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 200) as text", "cast(null as string) as source", "'x' as key", "1 as slot")
    out = sharding.interleave_shards(docs, 7, rows_per_bucket=50).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.sum() == 600 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    in_order = out.sort_values(["shard", "slot"]).text_crc32.tolist()
    assert in_order != sorted(in_order) and len(set(in_order[:150])) > 40


def test_many_languages():
    """Labels beyond 127 don't wrap."""
    scores = np.zeros((5, 200), np.float32)
    scores[:, 150] = 9
    assert language.best_paths(scores, np.array([3, 2]), 1.0).tolist() == [150] * 5


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_is_best_fit_decreasing(histogram):
    bins, used = {}, Counter()
    for length, first, last, per_bin, first_bin, at in packing.plan_slots(histogram, 30):
        used[length] += last - first + 1
        for rank in range(first, last + 1):
            bins.setdefault(first_bin + (rank - first) // per_bin, []).append((at + (rank - first) % per_bin * length, length))
    assert used == Counter(histogram)
    for items in bins.values():
        end = 0
        for at, length in sorted(items):
            assert at == end
            end += length
        assert end <= 30
    rooms = []
    for length in sorted((x for x in histogram for _ in range(histogram[x])), reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= length]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(30 - length)
    assert len(rooms) == len(bins)


def test_packing(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    out = packing.pack(odd, keep_ids=True).toPandas()
    whole = tokenizers.Tokenizer.from_file(packing.default_vocabulary())
    for doc_id, text, *_ in ODD:
        if doc_id is not None and doc_id != 4:
            own = out[out.doc_id == doc_id].sort_values("piece")
            assert np.concatenate(list(own.ids)).tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0]
    assert len(out[out.doc_id == 4]) == 2
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert packing.pack(odd.limit(0)).count() == 0


LOADED: list = []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBéÀß 's.,&<|endoftxt>1 \ńΣ»", max_size=15))
def test_word_ids(text):
    tokenizers = pytest.importorskip("tokenizers")
    if not LOADED:
        LOADED.extend([packing.WordIds(packing.default_vocabulary()), tokenizers.Tokenizer.from_file(packing.default_vocabulary())])
    cache, whole = LOADED
    assert np.frombuffer(cache.of(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
