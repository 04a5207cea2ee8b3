"""Ranked lexical search by the Best Position Algorithm (Akbarinia, Pacitti and Valduriez, 2007).

Every document is indexed with all its terms and their counts, one row per document, in
``build_index``.  A search reads that index once per block of queries.  A task's documents are
taken in shards of about ``SHARD_TERMS`` terms (or one document): a shard's postings of the
queries' terms become one list per term, ordered by impact.  A query reads its lists from the
top in parallel; each document met is looked up in all other lists (direct access), which yields
its whole score and marks its positions there.  A list's best position is the last one before
the first unmarked, often far beyond the last one read, and the impacts at the best positions
bound the score of every document not met.  Once that bound is strictly below the k-th best
score, which a task carries on from shard to shard, no other document can enter or tie, and the
query stops.  Shards' best documents are ranked on Spark.

The corpus statistics (documents, lengths, document frequencies) are exact aggregates over the
whole index.  Queries travel in blocks of about ``BLOCK_BYTES`` (or one query, if longer), one
after the other, so nothing that is broadcast grows with the benchmark or the corpus.

Terms are compared as strings.  A null text has no terms and a query without terms no result.
Repeated query ids, rows or document ids are separate queries and separate documents; equal
scores follow the document id, a null id last.  Documents of score 0 are not results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from oreline.llm.common import WORDS, arrow_stream, texts
from oreline.sources.paths import stored

BLOCK_BYTES = 1 << 22
# Bytes of text turned into index rows, or split into terms, at once.
SLICE = 1 << 22
# Terms of the documents in one shard, whose lists a task holds at once.
SHARD_TERMS = 1 << 20
# Fixed values of the score: saturation and length normalisation, in hundredths and thousandths.
LENGTH_SHARE, TF_SCALE, M_SCALE, IMPACT = 25, 1000, 12, 10**9


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term; a long text is split piece by piece."""
    text, counts, at = text.translate(WORDS), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        counts.update(text[at:end].split())
        at = end
    return counts


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document; lazy."""

    def rows(ids, counts):
        lengths = np.array([0, *map(len, counts)], np.int32)
        offsets = pa.array(np.cumsum(lengths, dtype=np.int32))
        terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
        tfs = pa.array([v for c in counts for v in c.values()], pa.int64())
        return {
            "doc_id": ids,
            "n": [sum(c.values()) for c in counts],
            "terms": pa.ListArray.from_arrays(offsets, terms),
            "tfs": pa.ListArray.from_arrays(offsets, tfs),
        }

    def run(batches):
        for batch in batches:
            ids, counts, size = [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                ids.append(i)
                counts.append(term_counts(text))
                size += len(text)
                if size >= SLICE:
                    yield rows(ids, counts)
                    ids, counts, size = [], [], 0
            if ids:
                yield rows(ids, counts)

    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return arrow_stream(named, run, "doc_id bigint, n bigint, terms array<string>, tfs array<bigint>")


def length_norm(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """100 - 25 + (25 * n * N) div L, exact where the product passes 64 bits."""
    if len(n) and LENGTH_SHARE * documents * int(n.max()) >= 2**63:
        share = np.array([LENGTH_SHARE * documents * int(x) // words for x in n], np.int64)
    else:
        share = LENGTH_SHARE * documents * n // max(words, 1)
    return 100 - LENGTH_SHARE + share


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, at = batch.column("terms").offsets.to_numpy(), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + SHARD_TERMS, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Shard:
    """Impact lists over one batch of the index, restricted to the vocabulary of the queries."""

    def __init__(self, batch: pa.RecordBatch, vocabulary: pa.Array, documents: int, words: int):
        lists, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
        self.size = batch.num_rows
        flat = lists.flatten()
        term = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(self.size), np.diff(lists.offsets.to_numpy()))
        known = term >= 0
        term, doc, tf = term[known], doc[known], tfs[known]
        m = length_norm(batch.column("n").to_numpy(), documents, words)
        impact = IMPACT * tf // (TF_SCALE * tf + M_SCALE * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))

    def search(self, query: list[tuple[int, int]], k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents, scores and the number of positions read for ``query`` (term, weight).

        ``best`` holds the k highest scores so far, ascending.  All documents of the shard
        that may belong to the k highest, ties included, are returned."""
        spans = [(self.starts[t], self.starts[t + 1], w) for t, w in query if self.starts[t] < self.starts[t + 1]]
        length = np.array([b - a for a, b, _ in spans], np.int64)
        base = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        total = int(base[-1])
        docs = np.concatenate([self.doc[a:b] for a, b, _ in spans] or [np.zeros(0, np.int64)])
        # One position more, of impact 0, stands for a document that a list lacks.
        score = np.concatenate([self.impact[a:b] * w for a, b, w in spans] + [np.zeros(1, np.int64)])
        place = np.full((len(spans), self.size), total, np.int64)
        for i in range(len(spans)):
            place[i, docs[base[i] : base[i + 1]]] = np.arange(base[i], base[i + 1])
        marked, met = np.zeros(total + 1, bool), np.zeros(self.size, bool)
        at = np.zeros(len(spans), np.int64)  # best positions: how many from the top are marked
        found, scores, depth, step = [], [], 0, 32
        while depth < (length.max() if len(spans) else 0):
            read = [docs[b : b + max(n - depth, 0)][:step] for b, n in zip(base + depth, length)]
            new = np.unique(np.concatenate(read))
            new = new[~met[new]]
            met[new] = True
            if len(new):
                places = place[:, new]
                marked[places] = True
                whole = score[places].sum(0)
                found.append(new)
                scores.append(whole)
                best = np.sort(np.concatenate([best, whole[whole > 0]]))[-k:]
            depth, step = depth + step, step * 2
            bound = 0
            for i, n in enumerate(length):
                ahead = marked[base[i] + at[i] : base[i + 1]]
                gap = int(ahead.argmin()) if len(ahead) else 0
                at[i] = n if len(ahead) and ahead[gap] else at[i] + gap
                if at[i] < n:
                    bound += int(score[base[i] + max(at[i] - 1, 0)])
            if len(best) == k and bound < best[0]:
                break
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        found, scores = np.concatenate(found), np.concatenate(scores)
        chosen = (scores > 0) & (scores >= (best[0] if len(best) == k else 1))
        return found[chosen], scores[chosen], int(np.minimum(length, depth).sum())


def _weights(index: DataFrame, queries: DataFrame, documents: int) -> DataFrame:
    """``query, term, weight`` of query terms that occur; weight counts repeats in the query."""
    occurring = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = queries.select("query", "block", F.arrays_zip("terms", "tfs").alias("z"))
    terms = terms.select("query", "block", F.explode("z").alias("z")).select("query", "block", "z.terms", "z.tfs")
    wanted = occurring.join(terms.select(F.col("terms").alias("term")).distinct(), "term", "left_semi")
    ratio = (2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)
    rare = stored(wanted.select("term", F.floor(1000 * F.log(ratio)).alias("w")), "weights")
    # The table of weights is read plainly, so that a term of very many queries can be split.
    return terms.join(rare, F.col("terms") == F.col("term")).where("w > 0").select(
        "query", "block", "term", (F.col("w") * F.col("tfs")).alias("weight")
    )


def search(
    index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = 20
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents.

    ``index`` is a stored ``build_index``, read once for the statistics and once per block of
    items.  Runs jobs; the ranking over shards is lazy."""
    named = items.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    queries = build_index(named).where("n > 0").withColumn("query", F.monotonically_increasing_id())
    queries = stored(queries, "queries")
    totals = index.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    documents, words = totals["documents"], totals["words"] or 0
    size = F.length(F.array_join("terms", " ")) + 16 * F.size("terms")
    blocks = max(1, math.ceil((queries.agg(F.sum(size).alias("n")).first()["n"] or 0) / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    weights = stored(_weights(index, queries.withColumn("block", block), documents), "query-terms")
    found = None
    for b in range(blocks):
        rows = weights.where(F.col("block") == b).select("query", "term", "weight").toArrow()
        vocabulary = rows.column("term").combine_chunks().unique()
        number = pc.index_in(rows.column("term"), value_set=vocabulary).to_pylist()
        per_query: dict[int, list[tuple[int, int]]] = {}
        for q, t, w in zip(rows.column("query").to_pylist(), number, rows.column("weight").to_pylist()):
            per_query.setdefault(q, []).append((t, w))
        shared = index.sparkSession.sparkContext.broadcast((vocabulary, per_query))
        part = stored(_best(index.where("n > 0"), shared, documents, words, top), "found")
        found = part if found is None else found.unionByName(part)
        shared.destroy()
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # First per share of the tasks, so that a query's documents of all tasks never meet at once.
    near = found.withColumn("share", F.col("task") % 64)
    near = near.withColumn("near", F.row_number().over(Window.partitionBy("query", "share").orderBy(*order)))
    ranked = near.where(F.col("near") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))
    )
    ids = queries.select("query", F.col("doc_id").alias("item_id"))
    return ranked.where(F.col("rank") <= top).join(ids, "query").select("item_id", "rank", "doc_id", "score")


def _best(index: DataFrame, shared, documents: int, words: int, top: int) -> DataFrame:
    """``query, task, doc_id, score``: at most ``top`` documents of each query and task."""

    def run(batches):
        vocabulary, queries = shared.value
        none = np.iinfo(np.int64).max
        best = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for q in queries}
        for batch in shards(batches):
            shard = Shard(batch.select(["terms", "tfs", "n"]), vocabulary, documents, words)
            column = batch.column("doc_id")
            ids, lacking = pc.fill_null(column, none).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            for q, query in queries.items():
                held = best[q]
                docs, scores, _ = shard.search(query, top, np.sort(held[0])[-top:])
                if len(docs):
                    score = np.concatenate([held[0], scores])
                    name, gone = np.concatenate([held[1], ids[docs]]), np.concatenate([held[2], lacking[docs]])
                    keep = np.lexsort((name, gone, -score))[:top]
                    best[q] = score[keep], name[keep], gone[keep]
        out = {"query": [], "doc_id": [], "score": []}
        for q, (score, name, gone) in best.items():
            out["query"] += [q] * len(score)
            out["doc_id"] += [None if g else i for i, g in zip(name.tolist(), gone.tolist())]
            out["score"] += score.tolist()
        yield out

    found = arrow_stream(index, run, "query bigint, doc_id bigint, score bigint")
    return found.withColumn("task", F.spark_partition_id())
