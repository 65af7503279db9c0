"""Average-linkage clusters of what one search found, with labels, outliers, a representative and the years they span.

Merging follows chains of nearest neighbours: a chain goes from a group to its most similar one until
two are each other's nearest, and these are merged. A merged group's similarities are the averages of
its parts weighted by size, so no pair of members is looked at again and all merges take time in the
square of the entries. Average linkage merges the same pairs in whatever order, so the merges are sorted by
similarity afterwards and cut where enough groups are left or what is left is too little alike.

What one search finds is bounded (some hundreds), and it is one group of Arrow Python.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Most clusters, the least similarity to merge at, the least members of a cluster, and what its label needs.
MOST, LEAST_COSINE, LEAST_MEMBERS, KEYWORDS, LABEL_WORDS, LEAST_INSIDE = 8, 0.18, 2, 6, 3, 0.4


def merges(sims: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges (similarity, a, b) of entries by average linkage; a and b are entries that stand for their groups."""
    n = len(sims)
    own = sims.astype(float).copy()
    np.fill_diagonal(own, -np.inf)
    size, live = np.ones(n), np.ones(n, bool)
    out: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.argmax(live))]
        last = chain[-1]
        near = own[last]
        best = near.max()
        nearest = chain[-2] if len(chain) > 1 and near[chain[-2]] == best else int(np.argmax(near))
        if len(chain) > 1 and nearest == chain[-2]:
            a, b = sorted((last, nearest))
            out.append((float(best), a, b))
            own[a] = (size[a] * own[a] + size[b] * own[b]) / (size[a] + size[b])
            own[:, a] = own[a]
            own[a, a] = own[b, :] = own[:, b] = -np.inf
            size[a] += size[b]
            live[b] = False
            chain = chain[:-2]
        else:
            chain.append(nearest)
    return out


def groups(sims: np.ndarray, most: int = MOST, least: float = LEAST_COSINE) -> list[list[int]]:
    """Entries in at most ``most`` groups, more where nothing is ``least`` alike."""
    n = len(sims)
    root = list(range(n))
    left = n
    for similarity, a, b in sorted(merges(sims), key=lambda m: -m[0]):
        if left <= most or similarity < least:
            break
        old, new = root[b], root[a]
        root = [new if r == old else r for r in root]
        left -= 1
    found: dict[int, list[int]] = {}
    for i, r in enumerate(root):
        found.setdefault(r, []).append(i)
    return list(found.values())


def _matrix(frame: pd.DataFrame) -> tuple[list, list, np.ndarray]:
    ids, terms = sorted(frame["id"].unique()), sorted(frame["term"].unique())
    weights = np.zeros((len(ids), len(terms)))
    np.add.at(weights, (frame["id"].map({x: i for i, x in enumerate(ids)}).to_numpy(), frame["term"].map({t: i for i, t in enumerate(terms)}).to_numpy()), frame["weight"].to_numpy())
    return ids, terms, weights


def clusters(vectors: DataFrame, most: int = MOST, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(corpus, id, cluster): clusters of sparse vectors (corpus, id, term, weight) of length one; a cluster is named by its smallest id."""

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, _, weights = _matrix(frame)
        found = groups(np.round(weights @ weights.T, 9), most, least_cosine)
        return pd.DataFrame([(key[0], ids[i], ids[min(g)]) for g in found for i in g], columns=["corpus", "id", "cluster"])

    return vectors.groupBy("corpus").applyInPandas(merge, "corpus long, id long, cluster long")


def keywords(group: list[int], held: list[set], df: Counter) -> list[str]:
    """The words of most of a group and of few others, by how much more of the group has them; later words first where that is equal."""
    inside = Counter(t for i in group for t in held[i] if len(t) >= 2)
    others = max(1, len(held) - len(group))
    scored = [(c / len(group) - (df[t] - c) / others, t) for t, c in inside.items() if c / len(group) >= LEAST_INSIDE]
    return [t for _, t in sorted(scored, reverse=True)[:KEYWORDS]]


def cluster_table(vectors: DataFrame, most: int = MOST, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(corpus, cluster, label, keywords, members, size, representative, first_year, last_year) of vectors (corpus, id, term, weight, citations, year).

    Clusters are numbered from 1 by falling size; entries alone are the row of cluster 0, without a label, and so
    are all entries of a corpus of under three. The representative is the member with the most citations, the first of several.
    """

    def describe(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids, terms, weights = _matrix(frame)
        facts = frame.groupby("id")[["citations", "year"]].first()
        cited, year = facts["citations"].fillna(0).to_dict(), facts["year"].to_dict()
        held = [{t for t, w in zip(terms, row, strict=True) if w} for row in weights]
        df = Counter(t for h in held for t in h)
        found = groups(np.round(weights @ weights.T, 9), most, least_cosine) if len(ids) >= 3 else [[i] for i in range(len(ids))]
        rows, alone = [], sorted(ids[i] for g in found if len(g) < LEAST_MEMBERS for i in g)
        for n, g in enumerate(sorted((g for g in found if len(g) >= LEAST_MEMBERS), key=lambda g: -len(g)), 1):
            words = keywords(g, held, df)
            members = sorted(ids[i] for i in g)
            years = sorted(int(year[m]) for m in members if year[m] == year[m] and year[m] is not None)
            rows.append((key[0], n, "、".join(words[:LABEL_WORDS]) or f"group {n}", words, members, len(members), max(members, key=lambda m: (cited[m], -m)), years[0] if years else None, years[-1] if years else None))
        if alone:
            rows.append((key[0], 0, None, [], alone, len(alone), None, None, None))
        return pd.DataFrame(rows, columns=["corpus", "cluster", "label", "keywords", "members", "size", "representative", "first_year", "last_year"]).astype({"representative": "Int64", "first_year": "Int64", "last_year": "Int64"})

    return vectors.groupBy("corpus").applyInPandas(describe, "corpus long, cluster long, label string, keywords array<string>, members array<long>, size long, representative long, first_year long, last_year long")
