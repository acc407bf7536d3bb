"""SimHash, substring dedup, decontamination, components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tamarisk.llm import components, decontamination, simhash, substrings
from tamarisk.llm.common import cut

WORD = re.compile(r"[^ \t-\r]+")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, x) for x in range(201, 240)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}
    for a, b in links:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert out == {x: find(parent, x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(rng, n):
    """Fingerprints with clusters, some of them dense."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for centre in out[:6]:
        out += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(40)]
    return out


@pytest.mark.parametrize("hot_values", [256, 2])
def test_links_are_whole(spark, hot_values):
    values = planted(random.Random(5), 300)
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    table = cut(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {(r["a"], r["b"]) for r in simhash.candidate_links(table, 4, hot_values).collect()}
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert found == expected


def signed(values):
    return sorted({v - (1 << 64) if v >> 63 else v for v in values})


def brute_components(values, radius):
    parent = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                low, high = sorted((find(parent, a), find(parent, b)))
                parent[high] = low
    return {v: find(parent, v) for v in values}


@pytest.mark.parametrize(("crowd", "hot_values"), [(16, 256), (3, 20), (1, 2), (1000, 256)])
def test_components_of_fingerprints(spark, crowd, hot_values):
    values = signed(planted(random.Random(7), 200))
    table = cut(spark.createDataFrame([(v,) for v in values], "fp long"))
    found = {r["fp"]: r["component"] for r in simhash.linked(table, 4, crowd, hot_values).collect()}
    assert {v: found.get(v, v) for v in values} == brute_components(values, 4)


def test_dense_group_gives_few_links(spark):
    """Links grow with the members of a dense group, not with their square."""
    rng, counts = random.Random(11), []
    for m in (200, 400):
        centre = rng.getrandbits(64)
        near = {centre}
        while len(near) < m:
            near.add(centre ^ sum(1 << b for b in rng.sample(range(64), 2)))
        values = signed([*near, *(rng.getrandbits(64) for _ in range(50))])
        table = cut(spark.createDataFrame([(v,) for v in values], "fp long"))
        plan = simhash.allocate(*simhash.bit_products(table), 4)
        stars = cut(simhash.star_links(table, plan))
        first = components.connected_components(stars).withColumnRenamed("node", "fp")
        of_values = cut(table.join(first, "fp", "left").selectExpr("fp", "coalesce(component, fp) as component"))
        counts.append(stars.count() + simhash.candidate_links(of_values, plan=plan).count())
        assert counts[-1] < 15 * m
        found = {r["fp"]: r["component"] for r in simhash.linked(table).collect()}
        assert {v: found.get(v, v) for v in values} == brute_components(values, 4)
    assert counts[1] < 3 * counts[0]


@pytest.mark.parametrize("text", ["", "one", "A b c d e f g", "x " * 70_000, " ".join(str(i % 977) for i in range(66_000)), "é\u00a0z y\tq\x0bw"])
def test_fingerprint_by_definition(text):
    """Majority of the XXH64 of all shingles, also beyond one chunk of them."""
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == expected


def test_hot_fingerprints(spark, monkeypatch):
    """Rows of a fingerprint that very many rows hold are looked up by broadcast, to the same end."""
    docs = spark.createDataFrame([(i, ["a b c d", "q r s t u", f"w{i} x{i} y{i} z{i}"][min(2, i % 5)]) for i in range(100)] + [(None, "a b c d")], "doc_id long, text string")
    plain = sorted(map(str, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "MANY_ROWS", 5)
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == plain


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(2)
    bits = rng.random((500, 64)) < 0.5
    together = bits.T.astype(float) @ bits
    for n in (100, 10_000, 10_000_000):
        plan = simhash.allocate(n, together, 4)
        assert sum(t + 1 for _, t in plan) == 5
        assert len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_simhash_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text), (9, text + " more"), (1, None), (2, ""), (7, "A b"), (8, "a B"), (None, text), (20, "entirely other words stand here in this one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    out = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    got = {k: v for k, v in out if k is not None}
    assert len(out) == len(rows)
    assert got[5] == got[3] == 3 and got[1] == got[2] == 1 and got[7] == got[8] == 7 and got[20] == 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.fingerprint("") == 0 and simhash.fingerprint("x y") == simhash.fingerprint("X  y\n")


def brute_removed(texts, k):
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if n[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("k", "bits", "hot"), [(35, 20, 1000), (35, 20, 5), (7, 20, 1000), (7, 20, 3), (4, 3, 1000), (4, 3, 1)])
def test_substrings(spark, k, bits, hot):
    rng = random.Random(k)
    vocabulary = [f"v{i}" for i in range(300)] + ["long" * 40, "é"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randrange(k - 1, 3 * k))] for _ in range(5)]
    texts = []
    for _ in range(80):
        parts = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 2 * k))]]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), [rng.choice(vocabulary) for _ in range(rng.randrange(0, k))]]
        texts.append(rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p))
    texts += [None, "", texts[0], texts[0], "same " * (4 * k), "one two", " ".join(shared[0]) + " tail"]
    docs = spark.createDataFrame([(i if i != 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as id")
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs, k, bits, hot_places=hot).collect()}
    expected = {(i if i != 7 else None): x for i, x in enumerate(brute_removed(texts, k))}
    assert out == expected


def test_passage_in_half_of_all_blocks(spark):
    """A passage that half of all blocks hold is counted in the tasks: its edges are in no bucket."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"{i}-{j}" for j in range(30)) + (f" {passage} tail{i}" if i % 2 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30, "doc_id")
    rows = cut(docs.selectExpr("cast(doc_id as string) as id", "xxhash64(text) as digest", "text"))
    _, minimisers, limit = substrings.sieve(rows, 35, 20, 50)
    hot = substrings.hot_edges(rows, 35, minimisers, limit)
    assert limit == 50 and len(hot.hashes) == 60 - 34
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs, 35, hot_places=50).collect()}
    assert out == dict(enumerate(brute_removed(texts, 35)))


def test_heads(spark):
    """Chains, lone links and a long chain, by following them."""
    rng = random.Random(4)
    names = rng.sample(range(1, 10**6), 400)
    chains = [names[:1], names[1:3], names[3:20], names[20:300], names[300:301], names[301:400]]
    size = {x: rng.randint(1, 9) for x in names}
    nodes = [(b, a, size[a]) for chain in chains for a, b in zip(chain, chain[1:])]
    found = {r["path"]: (r["head"], r["distance"]) for r in substrings.heads(spark.createDataFrame(nodes, "path long, before long, n_before long")).collect()}
    assert found == {x: (chain[0], sum(size[y] for y in chain[:i])) for chain in chains for i, x in enumerate(chain) if i}


@pytest.mark.parametrize("fragment", [1, 3])
def test_paths_of_many_fragments(spark, monkeypatch, fragment):
    """Paths over many fragments, with branches, repeated rows and a text that repeats itself."""
    monkeypatch.setattr(substrings, "FRAGMENT", fragment)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[50:390]), " ".join(base[:200] + ["x"] + base[200:]), " ".join(base[100:150] * 3), "same " * 90]
    texts += [" ".join(base[a : a + 60] + [f"t{a}"]) for a in rng.sample(range(300), 6)] + [texts[1], None, ""]
    docs = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect())
    assert out == Counter((i % 9, *x) for i, x in enumerate(brute_removed(texts, 35)))


@pytest.mark.parametrize("fragment", [1, 2, 128])
def test_fragments_that_share_a_digest(spark, monkeypatch, fragment):
    """With names of 8 bits very many digests collide, within paths and between heads; no removal is lost."""
    monkeypatch.setattr(substrings, "FRAGMENT", fragment)
    monkeypatch.setattr(substrings, "names_of", lambda h: h & np.uint64(0xFF00000000))
    rng = random.Random(fragment)
    texts = []
    for size in (45, 41, 36, 37, 35, 60, 90, 52, 39, 48):
        passage = [f"p{size}-{i}" for i in range(size)]
        texts += [" ".join([*(f"{size}a{i}" for i in range(rng.randrange(3))), *passage, *(f"{size}b{i}" for i in range(rng.randrange(3)))]) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()}
    assert out == dict(enumerate(brute_removed(texts, 35)))


def test_text_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 500)
    words = [f"w{i}" for i in range(3_000)]
    texts = [" ".join(words), " ".join(words[700:900]), "one two", " ".join(reversed(words)), " ".join(words[100:140]), " ".join(words[100:140])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs).collect()}
    assert out == dict(enumerate(brute_removed(texts, 35)))


def test_block_without_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i}-{j}" for j in range(50))) for i in range(6)], "doc_id long, text string")
    out = substrings.remove_repeats(docs.repartition(3), 35, 3).collect()  # the sieve lets all through
    assert len(out) == 6 and all(r["n_removed"] == 0 for r in out)


def test_substrings_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(docs).count() == 0


def test_rolling_and_smallest():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 50).astype(np.uint64)
    for k in (1, 2, 5, 18, 35):
        base = 0xD1342543DE82EF95
        slow = [sum(int(v) * pow(base, k - 1 - j, 2**64) for j, v in enumerate(x[i : i + k])) % 2**64 for i in range(51 - k)]
        assert substrings.rolling(x, k, np.uint64(base)).tolist() == slow
        assert substrings.smallest(x, k).tolist() == [int(x[i : i + k].min()) for i in range(51 - k)]


ITEMS = [
    (1, "A farmer named Alice has 12 apples and gives 5 kg of apples to Bob before the market opens on day 12 again"), (2, "short item of five words"), (3, None),
    (4, "42 43 44 45 46 47 48 49 50"), (5, "the quick brown fox jumps over the lazy dog near the old river bank today"), (5, "the quick brown fox jumps over the lazy dog near the old river bank today"),
]


def test_decontamination(spark):
    docs = [
        (1, "Intro text here. A farmer named Carol has 31 apples and gives 7 kg of apples to Dave before the market opens on day 31 again. Tail"),
        (2, "A farmer named Carol has 31 apples and gives 7 kg of apples to Dave before the market opens on day 99 again"), (3, "yes short item of five words indeed"),
        (4, None), (5, ""), (6, "42 43 44 45 46 47 48 49 50"), (7, "THE!! quick$$$ BROWN fox jumps over the lazy dog near the old river bank today"),
        (8, ITEMS[0][1]), (9, "the quick brown fox jumps over a lazy dog near an old water mill"), (None, "short item of five words"), (3, "yes short item of five words indeed"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as h", "3 as pos")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_items(docs, items).collect()}
    assert set(found) == {(1, 1), (3, 2), (7, 5), (8, 1), (None, 2)}
    assert (found[1, 1]["n_slots"], found[1, 1]["n_changed"]) == (6, 5) and found[8, 1]["n_changed"] == 0
    assert decontamination.find_items(docs.limit(0), items).count() == 0
    assert decontamination.find_items(docs, items.limit(0)).count() == 0


APPLES = "a farmer named Alice has 1200 apples and gives some of them to a neighbour before the market opens on friday"
COUNTS = "there are 3 apples and 5 pears in a bowl so how many pieces of fruit are there"
TWICE = "there are 2 apples and 2 plums in one box so how many pieces of fruit are left"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def test_decontamination_of_changed_questions(spark):
    texts = [
        APPLES.replace("Alice", "Mary Ann").replace("1200", "1 200"), WORDS.replace("ten ", "ten oh "), COUNTS.replace("3", "4").replace("5", "4"),
        TWICE.replace("2 a", "3 a").replace("2 p", "4 p"), "one two three four five six seven eight and then something else",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(0, APPLES), (1, WORDS), (2, COUNTS), (3, TWICE)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_items(docs, items, one_value=False).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert (found[0, 0]["n_slots"], found[0, 0]["n_changed"]) == (2, 1) and found[1, 1]["share"] == 1
    assert {r["doc_id"] for r in decontamination.find_items(docs, items).collect()} == {0, 1, 2}


def test_decontamination_of_short_items(spark):
    texts = ["so What is 12 + 7? I ask", "they asked What is the capital of France", "What is the capital of Spain?", "see 42 43 44 45 46 47 48 49 50 51", "What is 12 + 8?", "42 43 44 45 46 47 48 49", "then Tom Ben Ann went"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(0, "What is 12 + 7?"), (1, "What is the capital of France"), (2, "42 43 44 45 46 47 48 49 50"), (3, "Tom Ben Ann")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, items, wordless=True).collect()}
    assert found == {(0, 0), (1, 1), (2, 1), (3, 2), (6, 3)}


def test_decontamination_of_repeated_rows(spark):
    """Windows of repeated rows, and of different rows with one id, don't add up; the share is never above 1."""
    words = [f"w{i}" for i in range(32)]
    item, part = " ".join(words), " ".join(words[:17])  # 10 of 25 windows
    rows = [(1, part), (1, part), (2, part), (2, " ".join(words[15:])), (3, item), (3, item), (3, item), (None, item), (None, part), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "What is 2 plus 2"), (None, item)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["share"]) for r in decontamination.find_items(docs, items).collect()}
    assert found == {(3, 7): (25, 1.0), (None, 7): (25, 1.0)}


def brute_windows(item, doc, size=8, least=4):
    """Most windows of the item on one diagonal, where windows between two matched ones that touch count."""
    n = min(size, len(item))
    usable = [i for i in range(len(item) - n + 1) if len(set(item[i : i + n])) >= least]
    best = 0
    for shift in range(-len(item), len(doc)):
        at = [i for i in usable if 0 <= i + shift <= len(doc) - n and doc[i + shift : i + shift + n] == item[i : i + n]]
        filled = {x for a, b in zip(at, [*at[1:], None]) for x in (range(a, b) if b is not None and b - a <= n else [a])}
        best = max(best, len(filled & set(usable)))
    return best, len(usable)


def test_decontamination_by_brute_force(spark):
    """Random plain texts over a few words, with repeats, ties, nulls and empty texts."""
    rng = random.Random(23)
    vocabulary = [f"v{c}" for c in "abcdefghijkl"]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 30))] for _ in range(12)]
    items.append(items[0])
    docs = []
    for _ in range(60):
        item = rng.choice(items)
        low = rng.randrange(len(item))
        docs.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 20))] + item[low : low + rng.randint(1, 30)] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))])
    rows = [(i if i % 9 else None, " ".join(d)) for i, d in enumerate(docs)] + [(5, " ".join(docs[5])), (100, None), (101, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    of_items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"]) for r in decontamination.find_items(frame, of_items, max_shift=0).collect()}
    expected = {}
    for doc_id, text in rows:
        doc = (text or "").split()
        for item_id, item in enumerate(items):
            best, of = brute_windows(item, doc)
            if not of:  # word for word
                whole = any(doc[i : i + len(item)] == item for i in range(len(doc) - len(item) + 1))
                size = max(1, len(item) - 7)
                best, of = (size, size) if whole else (0, size)
            if best >= 0.5 * of and best:
                expected[doc_id, item_id] = max(expected.get((doc_id, item_id), (0, 0)), (best, of))
    assert found == expected


def test_recall_of_changed_questions(spark):
    """Questions of all lengths, asked again with other numbers and names, somewhere in a longer text."""
    rng = random.Random(31)
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    names = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi"]
    items, rows = [], []
    for i in range(80):
        kinds = [rng.choices("wna", (8, 1, 1))[0] for _ in range(8 + i % 60)]
        shape = [(k, rng.choice(plain)) for k in kinds]
        people = rng.sample(names, 8)
        asked = lambda people, add: " ".join(w if k == "w" else str(len(w) * 7 + add) if k == "n" else f"and {people[len(w)]}" for k, w in shape)  # noqa: B023, E731
        items.append((i, asked(people, 3)))
        rest = [" ".join(rng.choices(plain, k=30)) for _ in range(2)]
        rows += [(i, f"{rest[0]} {asked(people[::-1], 40)} {rest[1]}"), (1000 + i, " ".join(rng.choices(plain, k=60)))]
    docs = spark.createDataFrame([*rows, *rows[:20]], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(docs, spark.createDataFrame(items, "item_id long, text string"), one_value=False).collect()}
    assert sum((i, i) in found for i in range(80)) >= 0.9 * 80
    assert not any(doc >= 1000 for doc, _ in found)


def test_template_tokens_of_long_runs(spark):
    """op2: a long run of numbers or names is one placeholder, and takes no deeper stack than a short one."""
    for text, mark in (("1 " * 100_000, decontamination.NUMBER), ("a " + "Ab " * 100_000, decontamination.NAME)):
        tokens = spark.createDataFrame([(text,)], "text string").select(decontamination.template_tokens(F.col("text"))).first()[0]
        assert tokens[-1] == mark and len(tokens) <= 2
