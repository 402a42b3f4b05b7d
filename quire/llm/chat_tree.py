"""Chat formatting as prefix trees.

Turns are marked by a template; control strings inside texts are escaped
reversibly by a backslash before every ``[``, ``<`` and backslash, so no text can
open or close a turn. Conversations that begin with the same turns share them:
identical conversations become one path, paths with equal first turns one tree,
and each tree emits the tokens of every turn once, depth first, however many
conversations share it. A turn's row carries its tokens, the position ids they
have in any conversation that contains them (``position``, counted along the
path) and the stretches of the tree's token stream that its ancestors occupy
(``ancestors``), which with the turn itself are what its tokens may attend to.
The loss mask covers exactly the texts of the assistant.

The prefix that a turn ends is a node, named by two 64-bit hashes over the turns
up to it, computed as running aggregates. No tree is ever gathered: a node's
place is its way, the labels of the branches taken to reach it, so depth-first
order is the order of (tree, way, depth), and starts are running sums over ranges
of that order. Paths are only gathered one conversation at a time. Nodes that
many paths share are spread over tasks.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), role and text, and repeated rows are repeated turns; rows without a
conv_id form one conversation; a very long text is one turn of many tokens; an
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.recovery import checkpointed
from quire.llm.skew import hot_keys, spread_join

TEMPLATES = {"system": ("<<SYS>>", "<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SPECIAL = re.compile(r"[\\\[<]")
_TURN = re.compile(r"<<SYS>>(?P<system>(?:\\.|[^\\\[<])*)<</SYS>>\n|\[INST\] (?P<user>(?:\\.|[^\\\[<])*) \[/INST\]|\[ROLE (?P<role>(?:\\.|[^\\\[<\]])*)\](?P<other>(?:\\.|[^\\\[<])*)\[/ROLE\]| (?P<assistant>(?:\\.|[^\\\[<])*)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def marks(role: str) -> tuple[str, str]:
    """What opens and closes a turn of this role."""
    return TEMPLATES.get(role) or ("[ROLE " + escape(role).replace("]", "\\]") + "]", "[/ROLE]")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return out


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Fixed value: how the vocabulary's texts are split before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=1)
def _load(path: str):
    """One tokenizer (ranks of byte strings, one a line) for all batches that a Python worker sees."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("conversations", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def _tokens(path: str):
    """The tokens of each turn with its marks, and which of them carry loss."""

    def run(batches):
        tokenizer = _load(path)
        encode = functools.partial(tokenizer.encode_to_numpy, allowed_special=set(), disallowed_special=())
        known = functools.lru_cache(maxsize=1000)(lambda role: tuple(encode(m) for m in marks(role)))
        for batch in batches:
            ids, loss_from, loss_to = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                opened, closed = known(role)
                body = encode(escape(text))
                ids.append(np.concatenate([opened, body, closed]))
                assistant = role == "assistant"
                loss_from.append(len(opened) * assistant)
                loss_to.append((len(opened) + len(body)) * assistant)
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lengths), lists, pa.array(loss_from, pa.int64()), pa.array(loss_to, pa.int64())], ["node", "length", "ids", "loss_from", "loss_to"])

    return run


def paths_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each turn with its depth, the name of the prefix it ends (``node``), that of the prefix before (``parent``), of the first turn (``tree``) and of the whole conversation (``path``)."""
    slim = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    slim = slim.withColumn("depth", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = lambda seed: F.hex(F.bit_xor(F.xxhash64(F.lit(seed), "depth", F.hash("role", "text"), "role", "text")).over(upto))
    slim = slim.withColumn("node", F.concat_ws("-", F.col("depth"), mark("a"), mark("b")))
    by_depth = Window.partitionBy("conv_id").orderBy("depth")
    whole = by_depth.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return slim.withColumns({"parent": F.lag("node").over(by_depth), "tree": F.first("node").over(whole), "path": F.last("node").over(whole)})


def _starts(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, way, depth, length, ...) with ``seq`` and ``start``, their places in depth-first order: running sums inside ranges of the order, and the sums of the ranges before."""
    ranges = checkpointed(nodes.repartitionByRange("tree", "way", "depth").withColumn("range", F.spark_partition_id()))
    inner = Window.partitionBy("range", "tree").orderBy("way", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("range", "tree").agg(F.sum("length").alias("tokens"), F.count("*").alias("turns"))
    bases = sums.select("range", "tree", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("first"))
    local = ranges.withColumns({"seq": F.count("*").over(inner) - 1, "start": F.sum("length").over(inner) - F.col("length")})
    placed = local.join(bases, ["range", "tree"])
    return placed.withColumns({"seq": F.col("seq") + F.col("first"), "start": F.col("start") + F.col("base")}).drop("range", "way", "base", "first")


def build(turns: DataFrame, tokenizer: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trees, chains, members): the turns of all trees, the nodes of each path, and each conversation's path.

    trees: tree, node, parent, depth, seq (depth-first), start, length, position,
    ancestors (starts and ends in turn), ids, loss_from, loss_to. A path is named
    by its last node.
    """
    named = checkpointed(paths_of(turns, **columns))
    members = named.select("conv_id", "path").distinct()
    # one conversation stands for all that are identical
    lead = members.groupBy("path").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("lead")).select(F.col("path").alias("own"), F.col("lead.conv_id").alias("lead_id"))
    lone = named.join(lead, (F.col("path") == F.col("own")) & F.col("conv_id").eqNullSafe(F.col("lead_id"))).select("path", "depth", "node", "parent", "tree", "role", "text")
    every = lambda *names: [F.any_value(c).alias(c) for c in names]
    nodes = checkpointed(lone.groupBy("node").agg(F.count("*").alias("wide"), F.min("path").alias("owner"), *every("depth", "parent", "tree", "role", "text")))
    coded = checkpointed(nodes.select("node", "role", "text").mapInArrow(_tokens(tokenizer or tokenizer_file()), "node string, length long, ids array<int>, loss_from long, loss_to long"))
    chains = lone.select("path", "depth", "node")
    hot = hot_keys(nodes, "node", "wide")
    # the ways: a child of a parent with several children adds its own label
    forks = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children")).where("children > 1")
    sized = nodes.drop("role", "text", "wide").join(coded.select("node", "length"), "node")
    # first turns have no parent; names of their own keep them from meeting in one task
    sized = sized.withColumn("fork", F.coalesce("parent", F.concat(F.lit("none "), "node")))
    labelled = spread_join(sized, forks.withColumnRenamed("parent", "fork"), "fork", hot_keys(forks, "parent", "children"), F.col("node"), "left")
    labelled = labelled.withColumn("label", F.when(F.col("children").isNotNull(), F.lpad(F.hex(F.xxhash64("node")), 16, "0"))).select("node", "owner", "parent", "tree", "length", "label")
    along = Window.partitionBy("path").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = spread_join(chains, labelled, "node", hot, F.col("path")).withColumns({"way": F.array_join(F.collect_list("label").over(along), ""), "position": F.sum("length").over(along) - F.col("length")})
    placed = checkpointed(_starts(walked.where("path = owner").select("node", "owner", "parent", "tree", "depth", "length", "position", "way")))
    # the stretches: one begins wherever a turn does not follow its parent directly
    steps = spread_join(chains, placed.select("node", "owner", "start", "length", "position"), "node", hot, F.col("path"))
    steps = steps.withColumn("before", F.lag(F.col("start") + F.col("length")).over(Window.partitionBy("path").orderBy("depth")))
    begin = F.when(F.col("before").isNull() | (F.col("before") != F.col("start")), F.struct("start", "position"))
    steps = steps.withColumn("begins", F.collect_list(begin).over(along)).where("path = owner")
    last = F.size("begins")
    ends = lambda x, i: F.when(i + 1 < last, F.get("begins", i + 1)["position"]).otherwise(F.col("position")) - x["position"]
    spans = F.flatten(F.filter(F.transform("begins", lambda x, i: F.array(x["start"], x["start"] + ends(x, i))), lambda x: x[1] > x[0]))
    trees = placed.drop("owner").join(steps.select("node", spans.alias("ancestors")), "node").join(coded.drop("length"), "node")
    return trees.select("tree", "node", "parent", "depth", "seq", "start", "length", "position", "ancestors", "ids", "loss_from", "loss_to"), chains, members


def _texts(path: str):
    """The text of each turn, marks included, and the part of it under the loss mask, from its tokens."""

    def run(batches):
        decode = _load(path).decode_bytes
        for batch in batches:
            formatted, said = [], []
            for ids, a, b in zip(batch.column("ids").to_pylist(), batch.column("loss_from").to_pylist(), batch.column("loss_to").to_pylist(), strict=True):
                said.append(decode(ids[a:b]).decode())
                formatted.append(decode(ids[:a]).decode() + said[-1] + decode(ids[b:]).decode() if b else decode(ids).decode())
            kept = [c for c in batch.schema.names if c not in ("ids", "loss_from", "loss_to")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(formatted, pa.string()), pa.array(said, pa.string())], [*kept, "formatted", "said"])

    return run


def _read(batches):
    """The conversations, read back from the turns of their path that lie in the last turn's attention stretches."""
    for batch in batches:
        out = []
        for path, spans, turns in zip(*(batch.column(c).to_pylist() for c in ("path", "ancestors", "turns")), strict=True):
            own = turns[-1]
            starts = np.array([t["start"] for t in turns[:-1]], dtype=np.int64)
            bounds = np.array(spans, dtype=np.int64)
            # outside a stretch the number of bounds up to a start is even; turns without tokens take no room
            seen = [t for t, odd in zip(turns[:-1], np.searchsorted(bounds, starts, side="right") % 2, strict=True) if odd]
            if sum(t["length"] for t in seen) != own["position"] or own["position"] != int((bounds[1::2] - bounds[::2]).sum()):
                raise ValueError(f"the stretches of {path} do not cover its turns")
            seen.append(own)
            formatted = "".join(t["formatted"] for t in seen)
            read = read_turns(formatted)
            said = unescape("".join(t["said"] for t in seen))
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in read).encode()).hexdigest()
            out.append((path, len(read), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted), own["position"] + own["length"]))
        names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digest(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation what reading its tree back yields."""
    trees, chains, members = build(turns, tokenizer)
    slim = trees.select("node", "start", "length", "position", "ancestors", "ids", "loss_from", "loss_to")
    texts = slim.mapInArrow(_texts(tokenizer or tokenizer_file()), "node string, start long, length long, position long, ancestors array<long>, formatted string, said string")
    hot = hot_keys(chains.groupBy("node").agg(F.count("*").alias("n")), "node")
    turn = F.struct("start", "depth", "length", "position", "formatted", "said")
    whole = spread_join(chains, texts, "node", hot, F.col("path")).groupBy("path").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max(F.when(F.col("node") == F.col("path"), F.col("ancestors"))).alias("ancestors"))
    read = whole.select("path", "ancestors", "turns").mapInArrow(_read, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
    shared = hot_keys(members.groupBy("path").agg(F.count("*").alias("n")), "path")
    return spread_join(members, read, "path", shared, F.col("conv_id")).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` plus conversation -7, whose texts are made of the template's own control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
