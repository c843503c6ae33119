"""Ranked lexical search by the Best Position Algorithm.

Every term has an impact list: its documents by falling impact. All lists of an item are read from the top; a document
met in one list is looked up in all others at once (direct access), which gives its whole score and its position in each.
The best position of a list is the last one before which no position is unseen, however it was seen. A document
not yet met stands behind the best position of every list, so the impacts there add up to a bound for its
score. It falls faster than the bound from the positions last read. Reading stops when it is strictly below the k-th score.

Documents are searched in shards of bounded size, each with impact lists of its own; a task carries its k-th scores from
shard to shard, so that most items stop early in later shards, and sends ``k`` rows an item.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import arrow_batches, arrow_schema, ddl
from starloom.llm.words import word_lists
from starloom.scratch import staged

K = 20
TERMS_AT_ONCE = 1 << 12  # distinct terms of the items searched for in one pass over the documents
CELLS = 1 << 22  # of a shard's table for direct access
FIRST_READ = 16
BATCH_BYTES = 6 << 20
SALTS = 64


def _counted(text: bytes) -> Counter:
    found: Counter = Counter()
    for words in word_lists(text):
        found.update(words)
    return found


class Shard:
    """The impact lists of some documents, numbered from 0, and a table of all impacts for direct access."""

    def __init__(self, size: int, terms: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        """``term``, ``doc`` and ``impact``: one entry for each term of each document."""
        used = impact > 0
        term, doc, impact = term[used], doc[used], impact[used]
        order = np.lexsort((doc, -impact, term))
        self.size, self.doc, self.impact = size, doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))
        self.table = np.zeros((terms, size), np.int64)
        self.table[term, doc] = impact

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their scores: all that score at least the k-th score, and at least ``least``, and above 0.

        ``terms`` are distinct, each counts ``times`` times. ``least`` is a score that ``k`` documents elsewhere reach, or 0.
        """
        spans = [slice(*self.starts[t : t + 2]) for t in terms]
        lists = [(self.doc[s], self.impact[s]) for s in spans]
        seen = np.zeros(self.size, bool)
        best = [0] * len(lists)  # per list the first position that is unseen
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        kth, read = least, FIRST_READ
        while True:
            bound = sum(int(n * own[at]) for (_, own), n, at in zip(lists, times, best, strict=True) if at < len(own))
            if bound == 0 or bound < kth:
                break
            met = np.unique(np.concatenate([own[at : at + read] for (own, _), at in zip(lists, best, strict=True)]))
            met = met[~seen[met]]
            seen[met] = True
            docs = np.concatenate([docs, met])
            scores = np.concatenate([scores, (self.table[terms[:, None], met] * times[:, None]).sum(axis=0)])
            if len(scores) >= k:
                kth = max(kth, int(np.partition(scores, -k)[-k]))
            for i, (own, _) in enumerate(lists):
                while best[i] < len(own):
                    run = seen[own[best[i] : best[i] + 2 * read]]
                    if run.all():
                        best[i] += len(run)
                    else:
                        best[i] += int(run.argmin())
                        break
            read *= 2
        wanted = (scores >= kth) & (scores > 0)
        return docs[wanted], scores[wanted]


def _item_blocks(items: DataFrame, id_col: str, text_col: str, terms_at_once: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``terms_at_once`` terms: (id, tie, {term: times}); items without terms are left out."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    rows = rows.withColumn("tie", F.xxhash64("text"))
    schema = f"{ddl(rows, id='id', tie='tie')}, terms array<string>, times array<int>"
    out_schema = arrow_schema(schema)

    def count(batches):
        for batch in batches:
            found = [_counted(t.encode()) for t in batch.column("text").to_pylist()]
            terms = pa.array([[t.decode() for t in f] for f in found], pa.list_(pa.string()))
            times = pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))
            kept = [batch.column("id"), batch.column("tie"), terms, times]
            yield pa.RecordBatch.from_arrays(kept, schema=out_schema)

    found = staged(rows.select("id", "tie", "text").mapInArrow(count, schema).filter("size(terms) > 0"), "search-items")
    total = found.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-total // terms_at_once)
    for block in range(blocks):
        own = found.filter(F.pmod(F.xxhash64("id", "tie"), F.lit(blocks)) == block).collect()
        if own:
            yield [(r.id, r.tie, dict(zip(r.terms, r.times, strict=True))) for r in own]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document ``id``, ``tie``, ``n`` (all its terms), and the ``terms`` of the vocabulary in it with their ``times``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    schema = f"{ddl(rows, id='id', tie='tie')}, n bigint, terms array<int>, times array<int>"
    out_schema = arrow_schema(schema)

    def count(batches):
        for batch in batches:
            sizes, terms, times = [], [], []
            for text in batch.column("text"):
                found = _counted(text.as_py().encode())
                sizes.append(found.total())
                known = found.keys() & vocabulary.keys()
                terms.append([vocabulary[t] for t in known])
                times.append([found[t] for t in known])
            arrays = [pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), *arrays], schema=out_schema)

    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return staged(rows.mapInArrow(count, schema), "search-postings")


def _term_weights(postings: DataFrame, texts: int, terms: int) -> np.ndarray:
    """Per term floor(1000 ln((2N + 2) / (2 df + 1))) of the ``texts`` documents that hold a term at all."""
    holding = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row a term
    weights = np.zeros(terms, np.int64)
    for row in holding:
        weights[row.term] = math.floor(1000 * math.log((2 * texts + 2) / (2 * row["count"] + 1)))
    return weights


def _search(
    postings: DataFrame, items: list[tuple], vocabulary: dict[bytes, int], item_type: str, k: int, cells: int
) -> DataFrame:
    """Per task and item at most ``k`` documents: ``item``, ``item_tie``, ``id``, ``tie``, ``score``."""
    texts, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = _term_weights(postings, texts, len(vocabulary))
    wanted = [
        (np.array([vocabulary[t.encode()] for t in terms]), np.array(list(terms.values()), np.int64))
        for _, _, terms in items
    ]
    schema = f"item {item_type}, item_tie bigint, {ddl(postings, id='id', tie='tie')}, score bigint"
    out_schema = arrow_schema(schema)
    shard_docs = max(1, cells // len(vocabulary))

    def shards(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, shard_docs):
                some = batch.slice(low, shard_docs)
                terms = some.column("terms")
                doc = np.repeat(np.arange(some.num_rows), terms.value_lengths().to_numpy())
                term, tf = (some.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
                m = np.array([75 + 25 * n * texts // length for n in some.column("n").to_pylist()], np.int64)
                impact = weights[term] * (10**9 * tf // (1000 * tf + 12 * m[doc]))
                yield some, Shard(some.num_rows, len(vocabulary), term, doc, impact)

    def search(batches):
        tops: list[list[tuple]] = [[] for _ in items]  # (-score, id is null, id, tie), the best k in order
        for some, shard in shards(batches):
            ids, ties = some.column("id"), some.column("tie")
            for i, (terms, times) in enumerate(wanted):
                least = -tops[i][-1][0] if len(tops[i]) == k else 0
                for doc, score in zip(*(a.tolist() for a in shard.search(terms, times, k, least)), strict=True):
                    own = ids[doc].as_py()
                    tops[i].append((-score, own is None, 0 if own is None else own, ties[doc].as_py()))
                tops[i] = sorted(tops[i])[:k]
        rows = [
            (item, item_tie, None if null else own, tie, -score)
            for (item, item_tie, _), top in zip(items, tops, strict=True)
            for score, null, own, tie in top
        ]
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return postings.filter("size(terms) > 0").mapInArrow(search, schema)


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", terms_at_once: int = TERMS_AT_ONCE, cells: int = CELLS,
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: ``item_col``, ``item_tie`` (a hash of the item's text), ``rank``
    from 1, the id, ``tie`` (a hash of the text) and ``score``.

    A term's impact on a document is its weight (``_term_weights``) times (10^9 tf) div (1000 tf + 12 m) with
    m = 75 + (25 n N) div L, for tf occurrences among the document's n terms, N documents with a term and their L terms in
    all; the score adds up the impacts of the item's terms, repeats included. All is whole arithmetic. Equal scores are
    ranked by id, null ids last, then by ``tie``.

    Items are the stated queries: they are taken in blocks of about ``terms_at_once`` terms, one pass over the documents each,
    and only such a block is handed to the tasks. Documents stay where they lie; counts per document are written, and
    from every task ``k`` rows an item are shuffled. A shard has as many documents as fit ``cells``
    entries of its table.

    Every row of ``docs`` is a document, also if ids repeat. A null or empty text holds no term and counts for nothing. Items
    that are equal in id and text are one item; equal ids with other texts are items of their own. An item without terms, or
    whose terms no document holds, has no rows. Other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item {item_type}, item_tie long, {ddl(docs, id=id_col)}, tie long, score long")
    for block in _item_blocks(items, item_col, item_text_col, terms_at_once):
        terms = sorted({t for _, _, own in block for t in own})
        vocabulary = {t.encode(): n for n, t in enumerate(terms)}
        postings = _postings(docs, vocabulary, id_col, text_col)
        found = found.unionAll(_search(postings, block, vocabulary, item_type, k, cells))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("tie")]
    # Tasks send many rows an item: they are cut in salted groups first.
    for salt in ([F.pmod(F.xxhash64("id", "tie"), F.lit(SALTS))], []):
        best = Window.partitionBy("item", "item_tie", *salt).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select(
        F.col("item").alias(item_col), "item_tie", "rank", F.col("id").alias(id_col), "tie", "score"
    )
