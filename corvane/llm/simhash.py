"""SimHash near-dedup over a Gray-order hierarchical index.

A document's fingerprint has a bit for each bit of a 64-bit hash that is set in over half
of its word shingles. Fingerprints within ``radius`` bits are linked, and documents of one
connected component are near duplicates of each other.

The index has these levels. The uppermost nodes are shared masked bit patterns: with the 64
bits cut into ``blocks`` blocks, two fingerprints within ``radius`` bits agree on at least
``blocks - radius`` whole blocks, so each fingerprint is dealt to one node for every choice of
that many blocks and meets there all its neighbours (Spark shuffles by node). Inside a node
fingerprints are sorted by Gray rank, cut into leaves of 64 and those into groups of 16 leaves;
each keeps the mask and pattern of the bits that all its members share. A pair of groups, then
a pair of leaves, is pruned once the differences accumulated on bits that both share exceed the
radius; only what is left is compared bit by bit.

Equal fingerprints are collapsed first, so copies never meet each other; a node with very many
different fingerprints is cut into pairs of blocks (``groups.paired_blocks``).

Null and empty texts (no words) have fingerprint zero and are linked like any other. A text of
fewer words than a shingle is one shingle. A class of equal fingerprints is known by the fingerprint, so
rows with one doc_id and different texts belong to different components if their texts do, and a
component is named by the smallest doc_id of its rows; a null doc_id stays a row of its own with a
null component. Other columns are not used.

``similar_rows`` is for a similarity instead of a radius: fingerprints only find candidates there,
and each pair of them is decided by the exact similarity of its sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.groups import paired_blocks, runs
from corvane.tables import written
from corvane.llm.tokens import LOWER_BYTES, U64, mix, strings

SHINGLE_WORDS = 3
RADIUS = 3
BLOCKS = 5
LEAF = 64
FANOUT = 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_ONE_SHOT = 200_000


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; A-Z lower-cased."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, dtype=U64)
    joined, n = b" ".join(words), len(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=U64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    lows = [0, *(ends[: n - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(lows, ends[k - 1 :].tolist(), strict=True)), dtype=U64, count=n - k + 1)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _ONE_SHOT):
        eight = np.ascontiguousarray(hashes[at : at + _ONE_SHOT].astype("<u8")).view(np.uint8).reshape(-1, 8)
        if len(eight) < 256:
            total += np.unpackbits(eight, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            continue
        for byte in range(8):
            total[byte * 8 : byte * 8 + 8] += np.bincount(eight[:, byte], minlength=256) @ _BITS
    return total


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; all but the first from remixed hashes. Zero without hashes."""
    out = np.zeros(words, dtype=U64)
    for w in range(words if len(hashes) else 0):
        of = hashes if not w else mix(hashes + U64(w * 0x9E3779B97F4A7C15 % (1 << 64)))
        out[w] = np.packbits(set_bits(of) * 2 > len(of), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, words: int = 1) -> DataFrame:
    """(doc_id, fp, wide): fp is the first word as a signed long, wide the others as bytes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, k), words) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([int(f[:1].view(np.int64)[0]) for f in fps], pa.int64()), pa.array([f[1:].tobytes() for f in fps], pa.binary())], ["doc_id", "fp", "wide"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, fp long, wide binary")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray code."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(shift)
    return x


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of blocks - radius whole blocks of the 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - radius)]


def mask_nodes(masks: list[int]) -> Column:
    """The upper nodes of a class: one for each mask of the first 64 bits."""
    return F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for t, m in enumerate(masks)])


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> np.ndarray:
    """Joins labels along links, block of links by block of links."""
    for i, j in links:
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label[:] = label[label]
            if (before == label).all():
                break
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def linked(fp: np.ndarray, wide: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """The smallest index that each fingerprint of one node of the index is linked with, links of links included."""
    n = len(fp)
    order = np.argsort(gray_rank(fp), kind="stable")
    fp, wide, side, label = fp[order], wide[order], side[order], np.arange(n)
    cross, whole = side.min() < 2, np.concatenate([fp[:, None], wide], axis=1)

    def shared(width: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.arange(0, n, width)
        return whole[first], ~(np.bitwise_or.reduceat(whole, first) ^ np.bitwise_and.reduceat(whole, first))

    def near(width: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pattern, mask = shared(width)
        far = np.zeros(len(a), dtype=np.int64)
        for word in range(whole.shape[1]):
            far += np.bitwise_count((pattern[a, word] ^ pattern[b, word]) & mask[a, word] & mask[b, word])
        return far <= radius

    tops = -(-n // (LEAF * FANOUT))
    a, b = np.triu_indices(tops)
    keep = near(LEAF * FANOUT, a, b)
    a, b = a[keep], b[keep]
    leaves = -(-n // LEAF)

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = np.arange(FANOUT)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = (v.ravel() for v in np.meshgrid(x * FANOUT + step, y * FANOUT + step, indexing="ij"))
            ok = (i < leaves) & (j < leaves) & (i <= j)
            i, j = i[ok], j[ok]
            ok = near(LEAF, i, j)
            for p, q in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                r, s = slice(p * LEAF, min(n, (p + 1) * LEAF)), slice(q * LEAF, min(n, (q + 1) * LEAF))
                if label[r].max() == label[r].min() == label[s].max() == label[s].min():
                    continue  # all of them are in one component already
                far = np.bitwise_count(fp[r][:, None] ^ fp[s][None, :]).astype(np.int32)
                if wide.shape[1]:
                    near_u, near_v = np.nonzero(far <= radius)
                    extra = np.bitwise_count(wide[r][near_u] ^ wide[s][near_v]).sum(axis=1)
                    ok2 = far[near_u, near_v] + extra <= radius
                    u, v = near_u[ok2], near_v[ok2]
                else:
                    u, v = np.nonzero(far <= radius)
                u, v = u + r.start, v + s.start
                ok3 = u < v if p == q else u >= 0
                if cross:
                    ok3 &= side[u] != side[v]
                if ok3.any():
                    yield u[ok3], v[ok3]

    label = _roots(n, links(), label)
    out = np.empty(n, dtype=np.int64)
    least = np.full(n, n, dtype=np.int64)
    np.minimum.at(least, label, order)
    out[order] = least[label]
    return out


def _small(key: np.ndarray, fp: np.ndarray, wide: np.ndarray, side: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rows of groups of at most ``size``: each row against the next, the next but one, and so on."""
    us, vs = [], []
    for d in range(1, size):
        u = np.flatnonzero(key[:-d] == key[d:])
        if not len(u):
            break
        v = u + d
        far = np.bitwise_count(fp[u] ^ fp[v]).astype(np.int32)
        ok = (far <= radius) & ((side[u] == 2) | (side[u] != side[v]))
        u, v, far = u[ok], v[ok], far[ok]
        if wide.shape[1] and len(u):
            ok = far + np.bitwise_count(wide[u] ^ wide[v]).sum(axis=1) <= radius
            u, v = u[ok], v[ok]
        us.append(u)
        vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def similar(classes: DataFrame, radius: int, nodes: Column, words: int = 1) -> DataFrame:
    """(a, b) edges that connect all classes (rep, fp, wide) within ``radius`` that share one of the upper nodes.

    Edges are stars around the smallest row of each group: they connect what links connect.
    """
    dealt = paired_blocks(classes.select("rep", "fp", "wide", F.explode(nodes).alias("node")), "node", "rep")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            part, rep, side = (table[c].to_numpy() for c in ("part", "rep", "side"))
            fp = table["fp"].to_numpy().view(U64)
            wide = np.frombuffer(b"".join(table["wide"].to_pylist()), dtype=U64).reshape(len(fp), words - 1) if words > 1 else np.zeros((len(fp), 0), U64)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sizes = np.diff(np.r_[first, len(part)])
            low = np.repeat(sizes <= LEAF, sizes) & np.repeat(sizes > 1, sizes)
            u, v = _small(part[low], fp[low], wide[low], side[low], LEAF, radius)
            small_reps = rep[low]
            a, b = [small_reps[u]], [small_reps[v]]
            for at, size in zip(first[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
                own = slice(at, at + size)
                root = linked(fp[own], wide[own], side[own], radius)
                moved = np.flatnonzero(root != np.arange(size))
                a.append(rep[own][moved])
                b.append(rep[own][root[moved]])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    placed = dealt.select("part", "side", "rep", "fp", "wide").repartition("part").sortWithinPartitions("part")
    return placed.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, radius: int = RADIUS, nodes: Column | None = None, words: int = 1) -> DataFrame:
    """(doc_id, fp, wide, component_id) for documents (doc_id, text, ...).

    ``nodes`` are the upper nodes; without them they are those that guarantee every pair within
    ``radius`` of 64 bits. With ``words`` > 1 the radius holds for the whole fingerprint.
    """
    fps = written(fingerprints(docs, k, words), "fingerprints")
    name = F.col("fp") if words == 1 else F.xxhash64("fp", "wide")
    classes = written(fps.where("doc_id is not null").groupBy("fp", "wide").agg(F.min("doc_id").alias("least")).withColumn("rep", name), "classes")
    edges = similar(classes, radius, mask_nodes(block_masks(max(BLOCKS, radius + 2), radius)) if nodes is None else nodes, words)
    placed = written(classes.join(connected_components(edges), F.col("rep") == F.col("node"), "left").select("fp", "wide", "least", F.coalesce("component", "rep").alias("component")), "placed")
    smallest = placed.groupBy(F.col("component").alias("_c")).agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, F.col("component") == F.col("_c")).select("fp", "wide", "component_id")
    return fps.where("doc_id is not null").join(named, ["fp", "wide"]).select("doc_id", "fp", "wide", "component_id").unionByName(fps.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


SIMILARITY = 0.8
WIDE_WORDS = 8
BANDS = 24
BAND_ROWS = 5
#: A pair at 0.8 differs in 59 to 82 of 512 bits on average, by the sets' sizes, and sets of 4 and 5 shingles in 96; with 4 standard deviations 131.
CANDIDATE_RADIUS = 132
VERIFY_ROWS = 1024

_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=U64) * U64(2) + U64(1)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, k))


def band_nodes(hashes: np.ndarray) -> np.ndarray:
    """A node for each band: BAND_ROWS minimum hashes of the set, which two sets share with a probability of their similarity to that power."""
    least = np.full(len(_ODD), np.iinfo(U64).max, dtype=U64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _ODD).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=U64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        out = mix(out + column)
    return out


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, rep, fp, wide, nodes) of documents: rep names the set of shingles, the fingerprint is of its members."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, fp, wide, nodes = [], [], [], []
            for t in strings(batch.column("text")):
                own = shingle_set(t, k)
                bits = fingerprint(own, WIDE_WORDS)
                rep.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                fp.append(int(bits[:1].view(np.int64)[0]))
                wide.append(bits[1:].tobytes())
                nodes.append(band_nodes(own).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(rep, pa.int64()), pa.array(fp, pa.int64()), pa.array(wide, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], ["doc_id", "text_key", "rep", "fp", "wide", "nodes"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(score, "doc_id long, text_key long, rep long, fp long, wide binary, nodes array<long>")


def verified_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest index that each set is connected with by pairs of an exact Jaccard similarity of ``similarity`` or more.

    A set in the largest component so far needs no search of its own: what could still join it is outside, and searches.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    _, name = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(name, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(name))
    begins, first = np.r_[0, ends[:-1]], np.r_[0, np.cumsum(sizes)]
    root, searched = np.arange(n), np.zeros(n, bool)
    while True:
        open_ = np.flatnonzero(~searched & (root != np.bincount(root).argmax()))
        if not len(open_):
            return root
        i = open_[0]
        searched[i] = True
        lists = [holders[begins[x] : ends[x]] for x in name[first[i] : first[i + 1]]]
        both = np.bincount(np.concatenate(lists), minlength=n) if lists else np.zeros(n, np.int64)
        alike = np.unique(root[(both > 0) & (both >= similarity * (sizes[i] + sizes - both) - 1e-9)])
        if len(alike) > 1:
            root[np.isin(root, alike)] = alike[0]


def verified(members: DataFrame, similarity: float, k: int) -> DataFrame:
    """(a, b) edges that connect all pairs of a candidate component (rep, component, text) that are exactly as similar."""
    dealt = paired_blocks(members, "component", "rep", VERIFY_ROWS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part", 256):
            part, rep = table["part"].to_numpy(), table["rep"].to_numpy()
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            a, b = [], []
            for at, size in zip(first.tolist(), np.diff(np.r_[first, len(part)]).tolist(), strict=True):
                if size > 1:
                    root = verified_roots([shingle_set(t, k) for t in strings(table["text"].slice(at, size))], similarity)
                    moved = np.flatnonzero(root != np.arange(size))
                    a.append(rep[at + moved])
                    b.append(rep[at + root[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    return dealt.select("part", "rep", "text").repartition("part").sortWithinPartitions("part").mapInArrow(search, "a long, b long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def similar_rows(docs: DataFrame, similarity: float = SIMILARITY, k: int = 5) -> DataFrame:
    """(doc_id, text_key, group) for every row of documents (doc_id, text): near duplicates at an exact Jaccard similarity of k-word shingles.

    The fingerprints are candidate search only. They have 512 bits of the set of shingles, and upper
    nodes are bands of minimum hashes: a pair at the threshold meets in one of 24 bands of five with
    probability 0.99993 and differs in at most CANDIDATE_RADIUS bits with four standard deviations to
    spare, whatever the sizes. Inside each component of candidates every pair is decided by its exact
    similarity, so no pair below the threshold is linked. text_key is a 64-bit hash of the text.
    """
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_hash(F.col("text")))
    rows = written(shingled(read, k), "shingled")
    classes = written(rows.groupBy("rep").agg(*[F.first(c).alias(c) for c in ("fp", "wide", "nodes")], F.min("text_key").alias("text_key")), "classes")
    candidates = connected_components(similar(classes, CANDIDATE_RADIUS, F.col("nodes"), WIDE_WORDS))
    wanted = classes.join(candidates, F.col("rep") == F.col("node")).select("rep", "component", F.col("text_key").alias("_key"))
    members = read.join(wanted, F.col("text_key") == F.col("_key")).groupBy("rep").agg(F.first("component").alias("component"), F.first("text").alias("text"))
    named = connected_components(written(verified(written(members, "members"), similarity, k), "verified"))
    return rows.join(named, F.col("rep") == F.col("node"), "left").select("doc_id", "text_key", F.coalesce("component", "rep").alias("group"))


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, k: int = 5) -> DataFrame:
    """(doc_id, component_id) of ``similar_rows``; component_id is the smallest doc_id of the group, null for a null doc_id."""
    rows = similar_rows(docs, similarity, k)
    least = rows.groupBy(F.col("group").alias("_group")).agg(F.min("doc_id").alias("_least"))
    return rows.join(least, F.col("group") == F.col("_group")).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("_least")).alias("component_id"))
