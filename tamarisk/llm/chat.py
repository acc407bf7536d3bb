r"""Chat formatting as a prefix tree.

A turn is written as ``### role: text</turn>\n`` with control strings inside texts escaped
(``\`` as ``\\``, ``###`` as ``\h``, ``</turn>`` as ``\t``; in roles also ``:`` as ``\c``),
and tokenised in three parts, so that the loss mask covers exactly the text of assistant turns.

Conversations that share their first turns share nodes: a node's id is a digest of all turns
up to it. Different conversations are sorted by their node ids within the tree of their first
turn; each then emits the nodes that the one before it doesn't have, which is the tree in
depth-first order with every shared token once. The order is made in two levels: buckets are
consecutive ranges of the sorted paths, so that a first turn that a third of all conversations
share is spread over many tasks, and no bucket's paths lie between those of another.

Output: a row for each node with its place in the tree's sequence, its first position id (the
tokens of its ancestors come before it), its token ids, the interval of its tokens that bear
loss, and the intervals of the tree's sequence that its tokens attend to besides themselves;
intervals that touch are one.

Nulls: a null text or role is empty, a row without a conversation id is a conversation of its own (with
a null id), so that no number of them has to be gathered; null turn numbers come first. Rows of one conversation with equal turn numbers follow in order of role and text;
repeated rows are repeated turns. A conversation is gathered whole, at a cost in proportion to its tokens. Columns
beyond conv_id, turn, role and text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.common import cut, map_batches

ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c"}
_BACK = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}
_IN_TEXT, _IN_ROLE = re.compile(r"\\|###|</turn>"), re.compile(r"\\|###|</turn>|:")
_ESCAPED, _TURN = re.compile(r"\\(.)"), re.compile(r"### (.*?): (.*?)</turn>\n", re.DOTALL)
_tokenizers: dict = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    return f"### {escape(role, True)}: ", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return _tokenizers[path]


#: Conversations that are tokenised together.
SLICE = 100
#: Nodes of a path that set its range; the driver samples keys of at most so many ids of 32 digits.
RANGE_NODES = 16
_NODE = "struct<node: string, role: string, ids: array<int>, loss_from: int, loss_to: int, before: long>"


def formatted_turns(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``conv_key, conv_id, turns``: nodes of each conversation with their tokens."""
    path = vocabulary or default_vocabulary()
    rows = conversations.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"),
    )
    gathered = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    gathered = gathered.union(rows.where("conv_id is null").select("conv_id", F.array("turn").alias("turns")))

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_batch = _tokenizer(path).encode_batch
        encode = lambda texts: (e.ids for e in encode_batch(texts, add_special_tokens=False))
        heads: dict[str, list[int]] = {}  # few roles, each written again and again
        for batch in (whole.iloc[low : low + SLICE] for whole in batches for low in range(0, len(whole), SLICE)):
            nodes = []
            new = sorted({t["role"] for turns in batch["turns"] for t in turns} - heads.keys())
            if len(heads) > 10_000:
                heads, new = {}, sorted({t["role"] for turns in batch["turns"] for t in turns})
            heads.update(zip(new, encode([turn_parts(role, "")[0] for role in new]), strict=True))
            bodies = encode([turn_parts("", t["text"])[1] for turns in batch["turns"] for t in turns])
            (foot,) = encode([turn_parts("", "")[2]])
            for turns in batch["turns"]:
                so_far, before, own = b"", 0, []
                for t in turns:
                    head, body = heads[t["role"]], next(bodies)
                    data = f"{len(t['role'])}:{t['role']}{t['text']}".encode("utf-8", "surrogatepass")
                    so_far = hashlib.blake2b(so_far + data, digest_size=16).digest()
                    loss = (len(head), len(head) + len(body)) if t["role"] == "assistant" else (0, 0)
                    own.append({"node": so_far.hex(), "role": t["role"], "ids": head + body + foot, "loss_from": loss[0], "loss_to": loss[1], "before": before})
                    before += len(head) + len(body) + len(foot)
                nodes.append(own)
            yield pd.DataFrame({"conv_id": batch["conv_id"].values, "turns": nodes})

    kind = dict(conversations.dtypes)["conv_id"]
    out = map_batches(gathered, tokenise, f"conv_id {kind}, turns array<{_NODE}>")
    number = F.monotonically_increasing_id().cast("string")
    return cut(out.withColumn("conv_key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.concat(F.lit("null"), number))))


def ordered_paths(turns: DataFrame) -> DataFrame:
    """Different conversations with their path of nodes, in buckets that are consecutive ranges of the sorted paths."""
    chains = turns.select(
        "conv_key",
        F.transform("turns", lambda t: t["node"]).alias("nodes"),
        F.transform("turns", lambda t: F.size(t["ids"])).alias("sizes"),
    )
    # The same conversation under many ids is one path.
    paths = chains.withColumn("leaf", F.element_at("nodes", -1)).groupBy("leaf").agg(F.min_by(F.struct("conv_key", "nodes", "sizes"), "conv_key").alias("c"))
    paths = paths.select("leaf", "c.*").withColumn("tree", F.col("nodes")[0]).withColumn("path", F.array_join("nodes", ""))
    spark = turns.sparkSession
    ranges = paths.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.substring("path", 1, RANGE_NODES * 32))
    return cut(ranges.withColumn("bucket", F.spark_partition_id()))


def prefix_trees(turns: DataFrame) -> DataFrame:
    """The nodes of all trees: ``tree, node, depth, start, length, position, role, ids, loss_from, loss_to, attends``.

    ``start`` is the node's place in its tree's depth-first token sequence.
    """
    paths = ordered_paths(turns)
    ends = paths.groupBy("tree", "bucket").agg(F.max_by("nodes", "path").alias("last"))
    ends = ends.withColumn("before_bucket", F.lag("last").over(Window.partitionBy("tree").orderBy("bucket"))).drop("last")
    in_bucket = Window.partitionBy("tree", "bucket").orderBy("path")
    ordered = paths.join(ends, ["tree", "bucket"]).withColumn("before", F.coalesce(F.lag("nodes").over(in_bucket), "before_bucket"))
    # A node's id stands for all turns up to it: common ids are the common first turns.
    ordered = ordered.withColumn("shared", F.coalesce(F.size(F.array_intersect("nodes", "before")), F.lit(0)))
    ordered = ordered.withColumn("shared", F.greatest("shared", F.lit(0)))
    new_sizes = F.slice("sizes", F.col("shared") + 1, F.size("sizes"))
    ordered = cut(
        ordered.withColumn("fresh", F.aggregate(new_sizes, F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("in_bucket", F.sum("fresh").over(in_bucket) - F.col("fresh"))
        .select("tree", "bucket", "path", "conv_key", "nodes", "sizes", "shared", "fresh", "in_bucket")
    )
    sums = ordered.groupBy("tree", "bucket").agg(F.sum("fresh").alias("n"))
    sums = sums.select("tree", "bucket", (F.sum("n").over(Window.partitionBy("tree").orderBy("bucket")) - F.col("n")).alias("of_bucket"))
    placed = ordered.join(sums, ["tree", "bucket"]).withColumn("from", F.col("of_bucket") + F.col("in_bucket"))

    own = placed.join(turns.select("conv_key", "turns"), "conv_key").withColumn("skipped", F.get("turns", F.col("shared"))["before"])
    fresh = own.select("tree", "conv_key", "from", "shared", "skipped", F.posexplode("turns").alias("at", "t")).where(F.col("at") >= F.col("shared"))
    nodes = cut(
        fresh.select(
            "tree",
            "conv_key",
            "t.node",
            (F.col("at") + 1).alias("depth"),
            (F.col("from") + F.col("t.before") - F.col("skipped")).alias("start"),
            F.size("t.ids").cast("long").alias("length"),
            F.col("t.before").alias("position"),
            "t.role", "t.ids", "t.loss_from", "t.loss_to", "from",
        )
    )
    # Shared ancestors stand elsewhere in the sequence; a conversation's own nodes follow each other.
    above = placed.where("shared > 0").select("conv_key", F.explode(F.slice("nodes", F.lit(1), F.col("shared"))).alias("node"))
    spans = above.join(nodes.select("node", "start", "length"), "node")
    spans = spans.groupBy("conv_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("length")).alias("to")))).alias("above")
    )
    interval = "array<struct<from: bigint, to: bigint>>"
    none = F.array().cast(interval)

    def joined(so_far, x):  # nodes that follow each other in the sequence are one interval
        last = F.try_element_at(so_far, F.lit(-1))
        longer = F.concat(F.slice(so_far, F.lit(1), F.size(so_far) - 1), F.array(F.struct(last["from"].alias("from"), x["to"].alias("to"))))
        return F.when(last["to"] == x["from"], longer).otherwise(F.concat(so_far, F.array(x)))

    spans = spans.withColumn("above", F.aggregate("above", none, joined))
    before = F.when(F.col("start") > F.col("from"), F.array(F.struct(F.col("from").alias("from"), F.col("start").alias("to")))).otherwise(none)
    return nodes.join(spans, "conv_key", "left").select(
        "tree", "node", "depth", "start", "length", "position", "role", "ids", "loss_from", "loss_to",
        F.concat(F.coalesce(F.col("above").cast(interval), none), before).alias("attends"),
    )


def read_back(trees: DataFrame, turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of every conversation, decoded from the nodes on its path."""
    path = vocabulary or default_vocabulary()
    steps = turns.select("conv_key", "conv_id", F.posexplode(F.transform("turns", lambda t: t["node"])).alias("at", "node"))
    found = steps.join(trees.select("node", "ids", "loss_from", "loss_to"), "node")
    gathered = found.groupBy("conv_key").agg(
        F.first("conv_id", ignorenulls=True).alias("conv_id"), F.sort_array(F.collect_list(F.struct("at", "ids", "loss_from", "loss_to"))).alias("parts")
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode_batch = _tokenizer(path).decode_batch
        decode = lambda ids: iter(decode_batch([x.tolist() for x in ids], skip_special_tokens=False)) if ids else iter(())
        for batch in (whole.iloc[low : low + SLICE] for whole in batches for low in range(0, len(whole), SLICE)):
            rows = []
            texts = decode([p["ids"] for parts in batch["parts"] for p in parts])
            masked = decode([p["ids"][p["loss_from"] : p["loss_to"]] for parts in batch["parts"] for p in parts if p["loss_to"]])
            for parts in batch["parts"]:
                whole = "".join(next(texts) for _ in parts)
                loss = "".join(unescape(next(masked)) for p in parts if p["loss_to"])
                read = parse(whole)
                said = "".join(f"{role}\n{text}\n" for role, text in read)
                rows.append((len(read), _sha(said), len(loss), _sha(loss), len(whole)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "conv_id", batch["conv_id"].values)
            yield out

    kind = dict(turns.dtypes)["conv_id"]
    return map_batches(
        gathered.select("conv_id", "parts"), digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
