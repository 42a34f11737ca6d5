"""Language identification by compression.

Each language has a zstandard raw-content dictionary of a bounded sample of labelled
texts. A text, lower-cased and with all but letters as single spaces, is compressed whole,
in blocks of BLOCK bytes, once with each dictionary; the language of the smallest total
wins, the first by name on a tie. Narrow margins are marked as rejected.

The sample: of each language, whole training texts in the order of a hash of doc_id until
dict_bytes are full, docs_per_lang of them at most. Texts over a 64th of dict_bytes come
last, so that many texts find room. Counts by the hash's first bits tell which rows can be among
the first docs_per_lang; only these are ordered, so no language is one task's work. Over max_langs
languages are an error, so what is collected and broadcast is at most max_langs times dict_bytes.

Null texts and texts without a letter: 'und', score 0, rejected. Without training rows every
text is 'und'. Rows of null lang train nothing; a null doc_id stands where the hash of null does.
Repeated rows are predicted each and sampled once. Very long texts go block by block. An
empty table gives no rows. Other columns do no harm: only doc_id and text are read for
predictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_arrow, quoted

BLOCK = 8192
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).encode()


def fit(train: DataFrame, docs_per_lang: int = 1024, dict_bytes: int = 114688, max_langs: int = 256) -> dict[str, bytes]:
    """Each language's dictionary, from columns doc_id, text and lang."""
    known = train.filter("lang is not null and text is not null").select("lang", "doc_id", "text", F.xxhash64("text").alias("th"), F.octet_length("text").alias("size"))
    late, key = F.col("size") > dict_bytes // 64, F.xxhash64("doc_id")
    known = known.withColumn("at", late.cast("long") * 256 + F.shiftright(key, 56) + 128)
    counts = known.groupBy("lang", "at").agg(F.count("*").alias("n"))
    so_far = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wanted = checkpointed(counts.withColumn("before", so_far).filter(F.col("before") < docs_per_lang).select("lang", "at"))
    if wanted.select("lang").distinct().count() > max_langs:
        raise ValueError(f"over {max_langs} languages to learn")
    # 512 rows a language at most
    some = known.drop("text").join(F.broadcast(wanted), ["lang", "at"], "left_semi")
    first = some.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(late, key, "doc_id", "th"))).filter(F.col("n") <= docs_per_lang)
    filled = F.coalesce(F.sum("size").over(W.partitionBy("lang").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    drawn = checkpointed(first.withColumn("filled", filled).filter(F.col("filled") < dict_bytes))
    place = drawn.groupBy("lang", "doc_id", "th").agg(F.min("n").alias("n"))
    same = [F.col("k.lang") == F.col("p.lang"), F.col("k.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("k.th") == F.col("p.th")]
    rows = known.alias("k").join(F.broadcast(place.alias("p")), same).select("k.lang", "n", F.substring("text", 1, dict_bytes).alias("text")).distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        out[r.lang] = (out.get(r.lang, b"") + plain(r.text) + b" ")[:dict_bytes]
    return out


def compressors(dictionaries: dict[str, bytes]) -> list:
    import zstandard as z

    # short matches (3 bytes) tell languages apart in short texts
    how = z.ZstdCompressionParameters.from_level(3, min_match=3, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False)
    out = []
    for content in dictionaries.values():
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(z.ZstdCompressor(dict_data=d, compression_params=how))
    return out


def sizes(text: str, using: list) -> list[int]:
    raw = plain(text)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in using]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.02) -> DataFrame:
    """docs with lang_pred, score (how much smaller the best size is than the next, from 0 to 1) and rejected."""
    names = sorted(dictionaries)
    shipped = docs.sparkSession.sparkContext.broadcast({k: dictionaries[k] for k in names})
    docs = docs.select(*(F.col(quoted(c)) for c in docs.columns if c not in ("lang_pred", "score", "rejected")))
    place = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        using = compressors(shipped.value)
        for batch in batches:
            pred, score = [], []
            for t in batch.column(place).to_pylist():
                if not names or not t or not _LETTER.search(t):
                    pred.append("und")
                    score.append(0.0)
                    continue
                found = sizes(t, using)
                best = min(range(len(names)), key=found.__getitem__)
                rest = min((s for i, s in enumerate(found) if i != best), default=None)
                pred.append(names[best])
                score.append(1.0 if rest is None else 1 - found[best] / rest)
            s = pa.array(score, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), s], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = map_arrow(docs, run, schema)
    return out.withColumn("rejected", F.col("score") < margin)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def digest(docs: DataFrame) -> DataFrame:
    """op3: learns where crc32(doc_id) mod 4 is not 2; predicts every document (a null doc_id trains nothing and is not held out)."""
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
