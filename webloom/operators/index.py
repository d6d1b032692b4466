"""Inverted index: a table of documents, postings with positions in buckets of terms, and a dictionary, stored and read by term."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.plans.session import materialize

FIELDS = ("id", "url", "title", "text", "host", "section", "author", "kind", "ftype", "date")
#: Analysed fields in the order of their codes; those after the first three are the folded twins of title and text.
ANALYSED = ("title", "text", "section", "title_kd", "text_kd")
FOLDED = {"title": "title_kd", "text": "text_kd"}
#: Documents a bucket of terms holds the postings of, and the parts of a bucket, so that a term of very many documents isn't one task's.
DOCS_A_BUCKET, PARTS = 200_000, 4
STORED = "id bigint, url string, title string, text string, host string, section string, author string, kind string, ftype string, date string, date_num bigint, chars int"


@dataclass(frozen=True)
class Index:
    """docs: stored fields, chars (length of the text) and sizes (tokens of each analysed field). postings: b, field, term, id, tf, size
    (tokens of the document's field), positions; sorted by field, term and id in each file of a bucket b. terms: field, term,
    doc_freq, total_freq. size: number of documents.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    buckets: int
    size: int

    def bucket(self, field: str, term: str) -> Column:
        """Number of the bucket that holds a term: a constant, so that only its files are opened."""
        return _bucket(F.lit(field), F.lit(term), self.buckets)

    def of(self, field: str, term: str) -> DataFrame:
        """Postings of one term, read from the pages of its bucket's files that hold it."""
        return self.postings.where((F.col("b") == self.bucket(field, term)) & (F.col("field") == field) & (F.col("term") == term))


def _bucket(field: Column, term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(field, term), F.lit(buckets)).cast("int")


def documents(df: DataFrame) -> DataFrame:
    """Index documents; nulls become ''. One row per key column id."""
    out = df.select("id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIELDS[1:]])
    return out.withColumns({"date_num": T.date_num(F.col("date")), "chars": F.length("text")})


def _grouped(doc: np.ndarray, code: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(document, code, positions) of every distinct pair of document and code; positions ascend."""
    key = doc.astype(np.int64) * max(width, 1) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(pos[order], pa.int32()))
    return doc[order][starts], code[order][starts], lists


def _folds(words: list[str]) -> list[str]:
    """T.fold of a vocabulary in Python."""
    table = T.folding_table()
    return [w if w.isascii() else T.without_marks(w.translate(table)) for w in words]


POSTING = pa.struct([("field", pa.int8()), ("term", pa.string()), ("positions", pa.list_(pa.int32()))])


def _analysed_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with its token arrays (columns _title, _text, _section) replaced by sizes and, for each document, its postings."""
    n = batch.num_rows
    sizes = np.zeros((n, len(ANALYSED)), np.int32)
    docs, fields, terms, lists = [], [], [], []

    def add(field: str, doc: np.ndarray, code: np.ndarray, pos: np.ndarray, words: pa.Array) -> None:
        at = ANALYSED.index(field)
        sizes[:, at] = np.bincount(doc, minlength=n)
        d, c, p = _grouped(doc, code, pos, len(words))
        docs.append(d)
        fields.append(np.full(len(d), at, np.int8))
        terms.append(words.take(pa.array(c)))
        lists.append(p)

    for field in ANALYSED[:3]:
        column = batch.column(batch.schema.get_field_index(f"_{field}"))
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(n), lengths)
        first = np.cumsum(lengths) - lengths
        add(field, doc, code, np.arange(len(code)) - np.repeat(first, lengths), flat.dictionary.cast(pa.string()))
        if field in FOLDED:
            words = _folds(flat.dictionary.to_pylist())
            ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
            code = np.array([ids[w] for w in words], np.int64)[code] if len(code) else code
            if "" in ids:  # a word of marks alone is no word when it is folded
                kept = code != ids[""]
                doc, code = doc[kept], code[kept]
            lengths = np.bincount(doc, minlength=n)
            first = np.cumsum(lengths) - lengths
            add(FOLDED[field], doc, code, np.arange(len(code)) - np.repeat(first, lengths), pa.array(list(ids), pa.string()))
    doc = np.concatenate(docs)
    order = pa.array(np.argsort(doc, kind="stable"))
    structs = pa.StructArray.from_arrays([pa.array(np.concatenate(fields)), pa.concat_arrays(terms), pa.concat_arrays(lists)], fields=list(POSTING)).take(order)
    vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), pa.int32()), structs)
    kept = [i for i, name in enumerate(batch.schema.names) if not name.startswith("_")]
    columns = [batch.column(i) for i in kept]
    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(ANALYSED), pa.int32()), pa.array(sizes.ravel())))
    return pa.RecordBatch.from_arrays([*columns, vectors], names=[*[batch.schema.names[i] for i in kept], "sizes", "vector"])


def build(docs: DataFrame, per_bucket: int = DOCS_A_BUCKET) -> Index:
    """The stored index of index documents: analysed once; folded words are folds of the batch's distinct words.

    Null and empty fields have no postings. Ids are given once each. An empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _analysed_batch(b)

    tokens = docs.select(*[c.split(" ")[0] for c in STORED.split(", ")], *[T.tokens(F.col(f)).alias(f"_{f}") for f in ANALYSED[:3]])
    stored = materialize(
        tokens.mapInArrow(run, f"{STORED}, sizes array<int>, vector array<struct<field: tinyint, term: string, positions: array<int>>>"),
        options={"parquet.bloom.filter.enabled#url": "true", "parquet.bloom.filter.expected.ndv#url": "1000000"},
    )
    size = stored.count()
    buckets = max(8, -(-size // per_bucket))
    names = F.array(*[F.lit(f) for f in ANALYSED])
    rows = stored.select("id", "sizes", F.explode("vector").alias("v")).select(
        names[F.col("v.field")].alias("field"), F.col("v.term").alias("term"), "id", F.size("v.positions").alias("tf"), F.col("sizes")[F.col("v.field")].alias("size"), F.col("v.positions").alias("positions")
    )
    rows = rows.withColumn("b", _bucket(F.col("field"), F.col("term"), buckets)).repartition(buckets * PARTS, "b", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    postings = materialize(rows.sortWithinPartitions("b", "field", "term", "id"), ["b"])
    counts = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_freq"))
    return Index(stored.drop("vector"), postings, materialize(counts.sortWithinPartitions("field", "term")), buckets, size)


def dictionary(index: Index, field: str, start: str = "", limit: int | None = None) -> DataFrame:
    """field, term, doc_freq, total_freq from start on, by their bytes in UTF-8; a further row would be the next cursor."""
    found = index.terms.where((F.col("field") == field) & (F.col("term") >= start))
    return found if limit is None else found.orderBy("term").limit(limit)


def field_stats(index: Index, fields: list[str]) -> DataFrame:
    """field, docs, tokens: documents with any token of a field, and its tokens."""
    size = {f: F.col("sizes")[ANALYSED.index(f)] for f in fields}
    row = index.docs.agg(*[x for f in fields for x in (F.count_if(size[f] > 0).alias(f"{f}_docs"), F.coalesce(F.sum(size[f]), F.lit(0)).alias(f"{f}_tokens"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_docs").alias("docs"), F.col(f"{f}_tokens").alias("tokens")) for f in fields])).alias("x")).select("x.*")


def posting_list(index: Index, field: str, term: str, limit: int) -> DataFrame:
    """id, tf, positions, doc_freq, total_freq of a term, documents with most occurrences first; frequencies are of the whole index."""
    total = index.terms.where((F.col("field") == field) & (F.col("term") == term)).select("doc_freq", "total_freq", F.lit(0).alias("_one"))
    top = index.of(field, term).orderBy(F.col("tf").desc(), "id").limit(limit)
    return top.withColumn("_one", F.lit(0)).join(F.broadcast(total), "_one").select("id", "tf", "positions", "doc_freq", "total_freq")  # a single row


def get_document(index: Index, url: str) -> DataFrame:
    """The document of a URL: the key reaches the scan, where bloom filters skip what doesn't hold it."""
    return index.docs.where(F.col("url") == url)


def chosen(index: Index, host: str | None = None, kind: str | None = None) -> DataFrame:
    docs = index.docs
    if host:
        docs = docs.where(F.col("host") == host)
    return docs.where(F.col("kind") == kind) if kind else docs


def list_documents(index: Index, host: str | None = None, kind: str | None = None, by_url: bool = False, from_: int = 0, size: int = 100) -> DataFrame:
    """The newest documents (unknown dates last), or all by URL, within the window of a page: twice what it needs, 200 to 5000 rows."""
    window = min(5000, max(2 * max(from_ + size, 1), 200))
    order = [F.col("url"), F.col("id")] if by_url else [F.col("date_num").desc(), F.col("url"), F.col("id")]
    return chosen(index, host, kind).orderBy(*order).limit(window)
