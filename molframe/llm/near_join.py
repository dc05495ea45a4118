"""Similarity join of documents on word n-grams: MinHash LSH forest, then exact verification.

Equal texts are one class, and classes are joined. A signature is cut into labels, one per tree of the forest. A tree's
labels in order are a prefix trie: a node of depth d is a prefix of d minima, and two classes are candidates if they meet in
a node. Matching starts at whole labels and ascends: after each pass the similarities of the pairs that met tell, by
their chance to meet at each depth, what share of all pairs at the threshold or above has met; while that is under the
target recall, prefixes are shortened to the longest that is expected to reach it, and only nodes that join several
children of the pass before are visited, for pairs that had not met.

Pairs in a node whose whole signatures deny the threshold are dropped, at nodes of every size, in blocks. The others are
gathered into components, and within a component the exact Jaccard similarity of every two shingle sets is computed, in
blocks again, so that a group of many near copies becomes many tasks and never a list of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import Scratch, bound_batches, settle, text_key
from .graph import components

WORDS = 5
THRESHOLD = 0.8
TREES, LABEL = 24, 6
#: Share of the pairs at the threshold or above that must have met in a tree, as estimated from those that have.
TARGET_RECALL = 0.9999
#: Signatures deny a pair whose estimate lies so many standard errors under the threshold.
SLACK = 5.0
#: Members of one block of a node whose pairs are screened.
NODE_BLOCK = 512
#: Members and shingles of one block of a component whose pairs are verified, about.
BLOCK, BLOCK_SHINGLES = 512, 125_000
#: Rows, or shingles, that the small groups of one task are batched to, about.
BATCH, BATCH_SHINGLES = 1024, 250_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240601)
_A = _random.integers(1, 1 << 63, TREES * LABEL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, TREES * LABEL, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run; none without words.

    Words are what lies between ASCII white space.
    """
    found = (text or "").encode("utf-8", "surrogatepass").split()
    if not found:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(found, object), categorize=False)
    width = min(words, len(h))
    rolled = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _PRIME + h[i : len(h) - width + 1 + i]
    return np.unique((rolled ^ (rolled >> np.uint64(32))) * _PRIME)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash signature: TREES * LABEL minima of 32 bits."""
    low = np.full(TREES * LABEL, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1024):
        values = (hashes[at : at + 1024, None] * _A + _B) >> np.uint64(32)
        np.minimum(low, values.min(axis=0), out=low)
    return low.astype(">u4")


def meeting_chance(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Chance that a pair meets at prefixes of ``depth`` in one tree at least."""
    return 1 - (1 - similarity**depth) ** TREES


def estimated_recall(meetings: np.ndarray, depth: int, at: int, threshold: float) -> float:
    """Share of the pairs at the threshold or above that meet at prefixes of length ``at``.

    ``meetings``: for each number of equal minima, how often pairs of that agreement met in a tree at prefixes of ``depth``. A
    pair of similarity s meets TREES * s ** depth times on average, so each meeting stands for the inverse of that
    in pairs, met or not. Agreements up to one standard error under the threshold count as at it.
    """
    share = np.arange(len(meetings)) / (len(meetings) - 1)
    error = (threshold * (1 - threshold) / (len(meetings) - 1)) ** 0.5
    s = np.maximum(share, threshold)
    pairs = np.where(share >= threshold - error, meetings, 0) / (TREES * s**depth)
    return float((pairs * meeting_chance(s, at)).sum() / pairs.sum()) if pairs.sum() else 1.0


_SIGNED = T.StructType([T.StructField("signature", T.BinaryType()), T.StructField("n", T.LongType())])


def _signed(words: int):
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:  # one set at a time is held
                found = shingles(t, words)
                rows.append((signature(found).tobytes(), len(found)))
            yield pd.DataFrame(rows, columns=_SIGNED.names)

    return F.pandas_udf(sign, _SIGNED)


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component under links a-b."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _units(columns: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows sorted by ``columns`` and then ``v``, and where the runs of equal columns begin and end."""
    order = np.lexsort((v, *reversed(columns)))
    change = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        change |= c[order][1:] != c[order][:-1]
    return order, np.concatenate([[0], np.flatnonzero(change) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)


_MET = "v long, r long, agree int, n long"


def _screen(least: float, depth: int, before: int):
    """Within nodes of ``depth``, pairs whose signatures agree in a share of ``least`` at least become links.

    Returns star-shaped links (v, r) of each connected set, and how many pairs met by number of equal minima. Pairs that met
    at the longer prefixes ``before`` are left out.
    """

    def met(sig: np.ndarray, tree: int, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
        mine = slice(tree * LABEL, tree * LABEL + before)
        for k, i in enumerate(left):
            js = left[k + 1 :] if right is None else right
            agree = (sig[js] == sig[i]).sum(axis=1)
            near = agree >= least * sig.shape[1]
            if depth < before:
                near &= (sig[js, mine] != sig[i, mine]).any(axis=1)
            if near.any():
                yield np.full(near.sum(), i), js[near], agree[near]

    def screen(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        order, bounds = _units([part[c].to_numpy() for c in ("node", "a", "b")], part["v"].to_numpy())
        tree, a, b, block, v = (part[c].to_numpy()[order] for c in ("tree", "a", "b", "block", "v"))
        sig = np.frombuffer(b"".join(part["signature"].to_pylist()), ">u4").reshape(len(v), -1).astype(np.uint32)[order]
        seen, ends, roots = np.zeros(sig.shape[1] + 1, np.int64), [], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            at, of = np.arange(low, high), block[low:high]
            sides = (at, None) if a[low] == b[low] else (at[of == a[low]], at[of == b[low]])
            near = list(met(sig, tree[low], *sides))
            if near:
                i, j, agree = (np.concatenate(x) for x in zip(*near))
                seen += np.bincount(agree, minlength=len(seen))
                label = _roots(high - low, i - low, j - low)  # rows of a unit are in order of v, so roots are the least
                moved = np.flatnonzero(label != np.arange(high - low))
                ends.append(v[low + moved])
                roots.append(v[low + label[moved]])
        ends, roots = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, roots))
        some = np.flatnonzero(seen)
        links = [pa.array(ends), pa.array(roots), pa.nulls(len(ends), pa.int32()), pa.nulls(len(ends), pa.int64())]
        counts = [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array(some.astype(np.int32)), pa.array(seen[some])]
        return pa.table([pa.chunked_array([x, y]) for x, y in zip(links, counts)], names=["v", "r", "agree", "n"])

    return screen


def jaccard_links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with exact Jaccard similarity at the threshold or above: within ``left`` (i < j), or across."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    columns = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, seen = np.unique(columns, return_inverse=True, return_counts=True)
    keep = seen[column] > 1  # what one set alone has adds to no intersection
    number = np.cumsum(seen > 1) - 1
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n, m = len(left), len(sets)
    common = np.zeros((n, m if right is None else m - n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    step = max(64, 6_000_000 // max(1, m))
    for at in range(0, total, step):
        a, b = np.searchsorted(column, (at, at + step))
        dense = np.zeros((m, min(step, total - at)), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        common += dense[:n] @ (dense if right is None else dense[n:]).T
    common = np.rint(common).astype(np.int64)
    union = sizes[:n, None] + (sizes if right is None else sizes[n:])[None, :] - common
    near = (common >= threshold * union - 1e-9) & (union > 0)
    i, j = np.nonzero(near)
    if right is None:
        i, j = i[i < j], j[i < j]
    return i, j


_LINKED = "v long, links long, root long, whole boolean"


def _verify(threshold: float, words: int):
    """Within components, or pairs of blocks of them, the links of each member and the least member that it is connected to."""

    def verify(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        order, bounds = _units([part[c].to_numpy() for c in ("component", "a", "b")], part["v"].to_numpy())
        a, b, block, blocks, v = (part[c].to_numpy()[order] for c in ("a", "b", "block", "blocks", "v"))
        text, out = part["text"], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            sets = [shingles(text[int(k)].as_py(), words) for k in order[low:high]]
            if a[low] == b[low]:
                i, j = jaccard_links(sets, None, threshold)
            else:
                left, right = np.flatnonzero(block[low:high] == a[low]), np.flatnonzero(block[low:high] == b[low])
                i, j = jaccard_links([sets[k] for k in left], [sets[k] for k in right], threshold)
                i, j = left[i], right[j]
            label = _roots(high - low, i, j)
            links = np.bincount(np.concatenate([i, j]), minlength=high - low)
            some = np.flatnonzero(links)
            out.append((v[low + some], links[some], v[low + label[some]], np.full(len(some), blocks[low] == 1)))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, k) for k in (np.int64, np.int64, np.int64, bool)]
        return pa.table([pa.array(c) for c in columns], names=["v", "links", "root", "whole"])

    return verify


def row_key(id_column: Column, key: Column) -> Column:
    """Sixteen bytes that name a row by id and text key; repeated rows share it."""
    named = F.coalesce(F.concat(F.lit("i"), id_column.cast("string")), F.lit("n")).cast("binary")
    return F.substring(F.unhex(F.sha2(F.concat(key, named), 256)), 1, 16)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col="doc_id", text_col="text",
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, group_id, n_copies``.

    ``class_id``: the smallest id among rows of equal text. ``n_links``: how many other texts have Jaccard similarity of
    at least ``threshold`` to it on runs of ``words`` words (similarity is exact; prefixes are shortened until the share
    ``recall`` of such pairs is estimated to have met). ``group_id``: the smallest id among texts connected by
    links. ``n_copies``: rows of equal text. Null and empty texts are one class; texts without words link to nothing.
    Repeated rows count as copies. An empty table gives no rows. Only the named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), text.alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        final = settle(_class_links(plain, threshold, words, recall, scratch))
    return plain.select("doc_id", "key").join(final, "key").select("doc_id", "class_id", "n_links", "group_id", "n_copies")


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: of its texts the one with the smallest id, once.

    A row without an id stands for its group only if no other row there has one. Of repeated rows any one stays.
    """
    key = text_key(F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text.alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        final = _class_links(plain, threshold, words, TARGET_RECALL, scratch)
        best = F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "key")).alias("b")
        kept = settle(final.groupBy("group").agg(best).select(row_key(F.col("b.class_id"), F.col("b.key")).alias("_row")))
    name = "_row"
    while name in docs.columns:
        name += "_"
    once = docs.withColumn(name, row_key(F.col(id_col), key)).dropDuplicates([name])  # repeats go before the shuffle
    return once.join(kept.withColumnRenamed("_row", name), name, "left_semi").select(*docs.columns)


def _links_of_forest(classes: DataFrame, threshold: float, recall: float, scratch: Scratch) -> DataFrame:
    """Star-shaped links (v, r) of the classes (``v, signature, n``) that meet in the forest and that signatures do not deny."""
    least = threshold - SLACK * (threshold * (1 - threshold) / (TREES * LABEL)) ** 0.5
    links, meetings = None, np.zeros(TREES * LABEL + 1, np.int64)
    depth = before = LABEL
    while True:
        prefix = lambda t, d: F.xxhash64(F.lit(t), F.substring("signature", 4 * LABEL * t + 1, 4 * d))
        trees = [F.struct(prefix(t, depth).alias("node"), prefix(t, before).alias("child"), F.lit(t).alias("tree")) for t in range(TREES)]
        entries = classes.where("n > 0").select(F.explode(F.array(*trees)).alias("e"), "v").select("e.*", "v")
        nodes = entries.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("child").alias("c1"), F.max("child").alias("c2"))
        nodes = nodes.where("members > 1" if depth == before else "c1 <> c2").select("node", F.ceil(F.col("members") / NODE_BLOCK).cast("int").alias("blocks"))
        met = scratch.keep(entries.select("node", "tree", "v").join(nodes, "node"))
        batches = max(1, -(-met.count() // BATCH))
        # in a node of several blocks, every two of them meet once
        block = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = met.join(classes.select("v", "signature"), "v").select("*", block.alias("block"), other).select(
            "node", "tree", "v", "signature", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("node"), F.lit(batches)))
            .otherwise(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))).alias("batch"),
        )
        found = scratch.keep(dealt.groupBy("batch").applyInArrow(_screen(least, depth, before), _MET))
        new = found.where("v is not null").select("v", "r")
        links = new if links is None else links.unionByName(new)
        for r in found.where("agree is not null").groupBy("agree").agg(F.sum("n").alias("n")).collect():  # one row per agreement
            meetings[r["agree"]] += r["n"]
        if depth == 1 or estimated_recall(meetings, depth, depth, threshold) >= recall:
            return links
        enough = [d for d in range(1, depth) if estimated_recall(meetings, depth, d, threshold) >= recall]
        before, depth = depth, max(enough, default=1)


def _class_links(plain: DataFrame, threshold: float, words: int, recall: float, scratch: Scratch) -> DataFrame:
    """(key, class_id, n_copies, n_links, group_id, group), one row per distinct text of rows (``doc_id, key, text``)."""
    bound_batches(plain.sparkSession)
    signed = plain.select("doc_id", "key", _signed(words)("text").alias("s"))
    classes = signed.groupBy("key").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("s").alias("s")
    )
    # numbered as they are written, so that a number names one class for good
    classes = scratch.keep(classes.select("key", "class_id", "n_copies", "s.*", F.monotonically_increasing_id().alias("v")))
    named = components(_links_of_forest(classes, threshold, recall, scratch), scratch)
    members = named.unionByName(named.select(F.col("root").alias("v"), "root").distinct())
    members = scratch.keep(members.join(classes.select("v", "key", "class_id", "n"), "v"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = members.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    wanted = members.join(large, "root", "left").select(
        F.col("root").alias("component"), "v", "n", row_key(F.col("class_id"), F.col("key")).alias("row"), blocks.alias("blocks"),
        F.pmod(F.xxhash64("v", F.lit(1)), blocks).cast("int").alias("block"),
    )
    wanted = scratch.keep(wanted)
    batches = max(1, -(-(wanted.agg(F.sum("n")).first()[0] or 0) // BATCH_SHINGLES))
    keyed = plain.select(row_key(F.col("doc_id"), F.col("key")).alias("row"), "text")
    # both sides grow with the corpus, so neither is ever broadcast: small inputs run the plan that large ones run
    texts = keyed.join(wanted.drop("n").hint("merge"), "row").groupBy("v", "component", "blocks", "block").agg(F.first("text").alias("text"))
    # every two blocks meet once: block b with each other one, as the pair (smaller, larger)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = texts.select("*", others).select(
        "component", "v", "blocks", "block", "text", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(batches)))
        .otherwise(F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))).alias("batch"),
    )
    linked = scratch.keep(dealt.groupBy("batch").applyInArrow(_verify(threshold, words), _LINKED))
    # a component in one block is connected there; those in several are connected over their blocks
    over = components(linked.where("not whole and root < v").select("v", F.col("root").alias("r")), scratch)
    links = linked.groupBy("v").agg(F.sum("links").alias("n_links"), F.min(F.when(F.col("whole"), F.col("root"))).alias("root"))
    over = over.withColumnRenamed("root", "far")
    told = scratch.keep(
        classes.drop("signature").join(links, "v", "left").join(over, "v", "left")
        .select("key", "class_id", "n_copies", "n_links", F.coalesce("far", "root", "v").alias("group"))
    )
    named = told.where("n_links > 0").groupBy("group").agg(F.min("class_id").alias("group_id"))
    return told.join(named, "group", "left").select(
        "key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links") > 0, F.col("group_id")).otherwise(F.col("class_id")).alias("group_id"), "group",
    )
