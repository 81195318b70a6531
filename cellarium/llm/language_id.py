"""Language ID by compression: the language whose dictionary compresses a text best.

For every language of the labelled rows a raw-content dictionary is filled from a
bounded sample: ``SAMPLE_DOCS`` documents (those of the smallest hash draws), of each
at most ``SAMPLE_CHARS`` characters; of what they have together the last ``DICTIONARY_BYTES`` bytes are used.  Of more than
``MOST_LANGUAGES`` languages those with the most rows are learned.  A text is lower-cased,
ASCII other than letters becomes a space, and what is left is compressed whole, in pieces of
``PIECE`` bytes, once with each dictionary; a piece starts from the dictionary alone, so that
long texts don't outgrow it.  The smallest sum of sizes wins, and the margin to the second,
as a share of the second's size, tells how sure that is.  Where rejection is asked for, a text of
``n`` bytes goes if its margin is below ``LEAST_MARGIN / sqrt(n)``, as in noise and in languages that weren't learned,
and its best dictionary saves less than ``LEAST_GAIN`` of what it takes without any: texts
that mix learned languages have narrow margins too, but their dictionaries help, and they stay.  Texts
below ``TELLING`` bytes stay, for clean ones are mostly as long with a dictionary as without.

Cases: a null text and one without any letter are ``und`` with score 0; of languages
with equal sizes the one with more learned rows is given (then the first by name), with score 0; if one language was learned
every other text gets it with score 1; if none was, all are ``und``.  Rows without a
language, and those held out, are never learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from cellarium.llm.common import bounded_batches, documents, held_out, unit, worker_cache

SAMPLE_DOCS = 200
#: Languages that are learned: those with the most rows, then the first by name.
MOST_LANGUAGES = 256
SAMPLE_CHARS = 2000
DICTIONARY_BYTES = 32 << 10
PIECE = 2 << 10
#: Lazy matching from 4 bytes on: faster levels miss short words, slower ones gain little.
PARAMETERS = {"window_log": 17, "chain_log": 15, "hash_log": 16, "search_log": 4, "min_match": 4, "target_length": 0, "strategy": zstandard.STRATEGY_LAZY}
UNKNOWN = "und"

#: The margin at which the score is one half.
HALF_MARGIN = 0.02
#: Measured on held-out texts and made ones (figures in the README): the margins of noise are below LEAST_MARGIN / sqrt(bytes),
#: its gains below LEAST_GAIN; clean texts are above both from TELLING bytes on.
LEAST_MARGIN = 0.5
LEAST_GAIN = 0.03
TELLING = 40

_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """The content of each language's dictionary, the language with most rows first.  What reaches the driver is bounded for each language."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in most.collect()}
    if not counts:
        return {}
    draw = unit(F.col("doc_id"), F.lit("language"))
    kept = F.lit(False)
    for name, n in sorted(counts.items()):
        # Twice as many as needed on average, so that enough are there; the surplus is cut below.
        kept = kept | ((F.col("lang") == name) & (draw < min(1.0, 2.0 * SAMPLE_DOCS / n)))
    sample = rows.filter(kept).select("lang", draw.alias("draw"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    found: dict[str, list[tuple[float, str]]] = {}
    for r in sample.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["draw"], r["text"]))
    out = {}
    for name, pieces in sorted(found.items()):
        out[name] = normalised("\n".join(t for _, t in sorted(pieces)[:SAMPLE_DOCS]))[-DICTIONARY_BYTES:]
    return {k: out[k] for k in sorted(out, key=lambda k: (-counts[k], k)) if out[k]}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compress = []
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS, write_checksum=False, write_content_size=False, write_dict_id=False)
        for content in dictionaries.values():
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            self.compress.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress)
        self.plain = zstandard.ZstdCompressor(compression_params=parameters).compress

    def told(self, text: str | None, least_margin: float = LEAST_MARGIN, least_gain: float = LEAST_GAIN) -> bool:
        """Whether the text is in a learned language, or in a mix of them."""
        name, _, margin, size = self.classify(text)
        if name == UNKNOWN or size < TELLING or margin >= least_margin / size**0.5:
            return name != UNKNOWN
        data = normalised(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        plain = sum(map(len, map(self.plain, pieces)))
        best = min(sum(map(len, map(compress, pieces))) for compress in self.compress)
        return plain - best >= least_gain * plain

    def classify(self, text: str | None) -> tuple[str, float, float, int]:
        """Language, score, margin and the bytes that were compared."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, 0
        if len(self.names) == 1:
            return self.names[0], 1.0, 1.0, 0
        data = normalised(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(map(len, map(compress, pieces))) for compress in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second if second else 0.0
        return self.names[best], margin / (margin + HALF_MARGIN), margin, len(data)


def _judged(docs: DataFrame, dictionaries: dict[str, bytes], judge: Callable[[Classifier, str | None], tuple], fields: list[pa.Field], doc_id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, held_out, the columns ``keep`` and those that ``judge`` gives of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    content = spark.sparkContext.broadcast(dictionaries)  # DICTIONARY_BYTES for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("language")
        key = ("language", tuple(content.value.items()))
        if key not in cache:
            cache[key] = Classifier(content.value)
        for batch in batches:
            found = [judge(cache[key], t.as_py()) for t in batch.column("_text")]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([f[i] for f in found], field.type) for i, field in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *[f.name for f in fields]])

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep], F.col(text).alias("_text")
    )
    schema = rows.drop("_text").schema
    for f in fields:
        schema = schema.add(f.name, from_arrow_type(f.type))
    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, compared, and the columns ``keep`` of every row."""
    fields = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("margin", pa.float64()), pa.field("compared", pa.int64())]
    return _judged(docs, dictionaries, Classifier.classify, fields, doc_id, text, keep)


def reject(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = LEAST_MARGIN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told, with the columns they came with."""
    judge = lambda classifier, t: (classifier.told(t, least_margin),)
    judged = _judged(docs, dictionaries, judge, [pa.field("told", pa.bool_())], doc_id, text, tuple(docs.columns))
    return judged.filter("told").select(*[F.col(f"`keep_{c}`").alias(c) for c in docs.columns])


def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_compression_language": op10_compression_language}
ORACLE_SQL: dict[str, str] = {}
