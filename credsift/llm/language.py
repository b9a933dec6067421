"""Language identification by Bayesian fusion of text, markup, address and host evidence.

The posterior of a language is the product of

* the likelihood of the text: a naive Bayes model over hashed byte trigrams, tempered by
  ``TEMPER`` as neighbouring trigrams overlap;
* the likelihood of the language declared in the markup, and that of the address suffix (top
  level domain and a leading two-letter path part), both learnt from all records;
* the prior of the host, smoothed towards that of its domain, which is smoothed towards that of
  all records. A record's own text is taken out of its host's and domain's counts first.

All counts are grouped sums of the text posteriors of all records with enough text. They combine
map-side, so a host with most rows costs no more than others. One class, ``und``, stands for text
in none of the languages: under it all trigrams are equally likely.

The trigram model is the only part fitted on a sample: of each known language about ``SAMPLE``
texts at most, chosen by a hash of their id and text, and one at least, however rare the language
is among the others. Every language with a letter in its sample is learnt; 2^16 counts each.

Defined results: missing evidence of a kind has no say; NULL and empty texts are judged by the
rest alone, and rejected when that leaves them undetermined; repeated rows are judged alike; a
record without an id is judged like any other; an empty table gives no rows; without any known
languages everything is ``und``. Other columns pass through ``kept_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsift.llm.common import free_name, hash_unit, row_key
from credsift.session import cut

UNDETERMINED = "und"
BUCKET_BITS = 16
# Texts of a language that teach its trigrams.
SAMPLE = 8_000
# Languages that a task counts side by side before it hands their counts on.
COUNTED = 64
TEMPER = 1 / 3
# Trigrams below which a text adds nothing to the counts of its host, markup and suffix.
ENOUGH = 30
# Records that a parent's share weighs in its child's.
HOST_STRENGTH, DOMAIN_STRENGTH, CATEGORY_STRENGTH = 5.0, 20.0, 10.0
CONFIDENCE = 0.35
CHUNK = 1 << 18

_HIDDEN = re.compile(
    rb"<!--.*?(?:-->|$)|<(script|style)\b.*?(?:</\1\s*>|$)|<[^>]*>|&#?\w{1,8};", re.I | re.S
)


# --- text model ------------------------------------------------------------------------------


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all byte trigrams with two letters at least.

    Everything but letters is a blank, and every text stands between blanks.
    """
    joined = b"".join(b" %b  " % t for t in texts).lower().translate(_PLAIN)
    octets = np.frombuffer(joined, dtype=np.uint8)
    if len(octets) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = octets[:-2].astype(np.uint32)
    code |= octets[1:-1].astype(np.uint32) << np.uint32(8)
    code |= octets[2:].astype(np.uint32) << np.uint32(16)
    keep = (octets[:-2] != 32).astype(np.uint8) + (octets[1:-1] != 32) + (octets[2:] != 32) > 1
    code = code[keep] * np.uint32(0x9E3779B1)
    ends = np.cumsum([len(t) + 3 for t in texts])
    number = np.repeat(np.arange(len(texts)), np.diff(
        np.searchsorted(np.flatnonzero(keep), np.concatenate([[0], ends]))
    ))
    return number, (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


_PLAIN = bytes(b if 97 <= b < 123 or 65 <= b < 91 or b >= 128 else 32 for b in range(256))


def visible(html: bytes) -> bytes:
    """The text of a page without markup, scripts and styles."""
    return _HIDDEN.sub(b" ", html)


def _chunks(texts: list[str | None], markup: bool) -> Iterator[tuple[int, list[bytes]]]:
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        octets = (text or "").encode("utf-8", "surrogatepass")
        held.append(visible(octets) if markup else octets)
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


@dataclass
class TextModel:
    """Log probabilities of every bucket, one row per language; the last row is ``und``."""

    languages: list[str]
    logs: np.ndarray

    @property
    def classes(self) -> list[str]:
        return [*self.languages, UNDETERMINED]


def train(texts: DataFrame, size: int = SAMPLE) -> TextModel:
    """The text model from rows of (id, text, language)."""
    # repeated ids and texts are in or out together, so ids alone would not do
    place = hash_unit("language-sample", F.concat_ws(":", "id", F.xxhash64("text")))
    known = texts.filter("text IS NOT NULL AND language IS NOT NULL").select(
        "text", "language", place.alias("_place")
    )
    # one row per language
    shares = cut(
        known.groupBy(F.col("language").alias("_language")).agg(
            F.greatest(F.lit(float(size)) / F.count("*"), F.min("_place")).alias("_share")
        ),
        "language-shares",
    )
    sample = known.join(
        shares, (F.col("language") == F.col("_language")) & (F.col("_place") <= F.col("_share"))
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def handed() -> Iterator[pd.DataFrame]:
            for language, own in sums.items():
                at = np.flatnonzero(own)
                yield pd.DataFrame({"language": language, "bucket": at, "n": own[at]})
            sums.clear()

        for batch in batches:
            for language, some in batch.groupby("language"):
                own = sums.setdefault(language, np.zeros(1 << BUCKET_BITS, dtype=np.int64))
                for _, part in _chunks(some["text"].tolist(), False):
                    own += np.bincount(trigrams(part)[1], minlength=1 << BUCKET_BITS)
                if len(sums) >= COUNTED:
                    yield from handed()
        yield from handed()

    # at most one row per language and bucket
    got = (
        sample.select("text", "language")
        .mapInPandas(count, "language string, bucket int, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    row, languages = pd.factorize(got["language"], sort=True)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[order], np.arange(len(languages) + 2))
    logs = np.empty((len(languages) + 1, 1 << BUCKET_BITS), dtype=np.float32)
    for k in range(len(logs)):  # no rows for the last one, ``und``
        own = np.full(1 << BUCKET_BITS, 0.05)
        some = order[ends[k] : ends[k + 1]]
        own[bucket[some]] += n[some]
        logs[k] = np.log(own / own.sum())
    return TextModel([str(x) for x in languages], logs)


def likelihoods(df: DataFrame, text: Column, model: TextModel, markup: bool) -> Column:
    """(logs, own): a text's tempered log likelihood per class, and what it adds to the counts of
    its host, markup and suffix: its posterior, or nothing where it has too few trigrams."""
    sent = df.sparkSession.sparkContext.broadcast(model.logs)

    @F.arrow_udf("logs array<double>, own array<double>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logs = sent.value
        for batch in batches:
            texts = batch.to_pylist()
            grams = np.zeros(len(texts), dtype=np.int64)
            sums = np.zeros((len(texts), len(logs)))
            for first, some in _chunks(texts, markup):
                number, bucket = trigrams(some)
                part = slice(first, first + len(some))
                grams[part] = np.bincount(number, minlength=len(some))
                for k, row in enumerate(logs):
                    sums[part, k] = np.bincount(number, row[bucket], minlength=len(some))
            sums *= TEMPER
            own = _softmax(sums) * (grams >= ENOUGH)[:, None]
            offsets = pa.array(np.arange(0, sums.size + 1, len(logs), dtype=np.int32))
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (sums, own)],
                ["logs", "own"],
            )

    return weigh(text)


# --- evidence --------------------------------------------------------------------------------


def declared_language(html: Column) -> Column:
    """The first part of the lang attribute of the html element, NULL if there is none."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,8})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.lower(authority), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column) -> Column:
    """The top level domain, with a leading two-letter part of the path if there is one."""
    part = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://[^/?#]*/([a-z]{2})(?:[-/?#]|$)", 1)
    return F.concat(F.substring_index(host_of(url), ".", -1), F.lit("/"), part)


def _softmax(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _sums(classes: int) -> Column:
    """The sums of the text posteriors of the records with enough text, as one array."""
    return F.array(*(F.sum(F.get("own", F.lit(k))) for k in range(classes)))


def _rows(found: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are not NULL, one row of numbers each, zeros for NULL) of a list array."""
    there = np.asarray(found.is_valid())
    rows = np.zeros((len(found), classes))
    rows[there] = found.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
    return there[:, None], rows


def _verdict(names: list[str], counted: np.ndarray) -> Callable[..., Column]:
    """(language, confidence) from logs, own, and the sums of domain, host, suffix, declared."""
    n = len(names)
    classes = pa.array(names, pa.string())
    top = counted / counted.sum()

    @F.arrow_udf("language string, confidence double")
    def fused(
        logs: pa.Array,
        own: pa.Array,
        domain: pa.Array,
        host: pa.Array,
        suffix: pa.Array,
        declared: pa.Array,
    ) -> pa.Array:
        _, own = _rows(own, n)

        def smoothed(found: pa.Array, parent: np.ndarray, strength: float) -> np.ndarray:
            there, sums = _rows(found, n)
            others = np.where(there, np.maximum(sums - own, 0.0), 0.0)
            return (others + strength * parent) / (others.sum(axis=1, keepdims=True) + strength)

        # how likely a class is to show this declaration or suffix, against all its others
        def said(found: pa.Array) -> np.ndarray:
            there, sums = _rows(found, n)
            share = sums.sum(axis=1, keepdims=True) / counted.sum()
            shown = (sums + CATEGORY_STRENGTH * share) / (counted + CATEGORY_STRENGTH)
            return np.log(shown, where=there & (shown > 0), out=np.zeros_like(shown))

        prior = smoothed(host, smoothed(domain, top, DOMAIN_STRENGTH), HOST_STRENGTH)
        posterior = _softmax(np.log(prior) + _rows(logs, n)[1] + said(suffix) + said(declared))
        best = posterior.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [classes.take(pa.array(best)), pa.array(posterior[np.arange(len(best)), best])],
            ["language", "confidence"],
        )

    return fused


def identify(
    records: DataFrame, model: TextModel, markup: bool = False
) -> DataFrame:
    """(key, language, confidence) of records (key, text, host, domain, suffix, declared).

    ``language`` is the class of the highest posterior, ``confidence`` that posterior.
    """
    names = model.classes
    kinds = ["domain", "host", "suffix", "declared"]
    weighed = records.select(
        "key", *kinds, likelihoods(records, F.col("text"), model, markup).alias("_e")
    )
    evidence = cut(
        weighed.select("key", *kinds, F.col("_e.logs"), F.col("_e.own")), "language-evidence"
    )
    whole = evidence.agg(_sums(len(names))).head()[0]
    counted = np.array([float(x or 0.0) + 1.0 for x in whole])
    joined = evidence
    for kind in kinds:
        sums = evidence.filter(F.col(kind).isNotNull()).groupBy(kind)
        sums = sums.agg(_sums(len(names)).alias(f"_{kind}"))
        joined = joined.join(cut(sums, f"language-{kind}"), kind, "left")
    fused = _verdict(names, counted)("logs", "own", *(f"_{kind}" for kind in kinds))
    verdicts = joined.select("key", fused.alias("_v")).select("key", "_v.language", "_v.confidence")
    # written, as a later filter pushed below these projections would judge the rows twice
    return cut(verdicts, "language-verdicts")


# --- tables ----------------------------------------------------------------------------------


def document_records(docs: DataFrame, key: Column) -> DataFrame:
    """Documents know no markup or address; their source takes the part of the host. Their
    ``lang`` is never evidence."""
    nothing = F.lit(None).cast("string")
    return docs.select(
        key.alias("key"),
        "text",
        F.col("source").alias("host"),
        nothing.alias("domain"),
        nothing.alias("suffix"),
        nothing.alias("declared"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    return pages.select(
        F.struct("page_id").alias("key"),
        F.col("html").alias("text"),
        host.alias("host"),
        domain_of(host).alias("domain"),
        suffix_of(F.col("url")).alias("suffix"),
        declared_language(F.col("html")).alias("declared"),
    )


def known_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"))


def accepted(languages: list[str] | None = None, confidence: float = CONFIDENCE) -> Column:
    sure = (F.col("language") != UNDETERMINED) & (F.col("confidence") >= confidence)
    return sure & F.col("language").isin(languages) if languages else sure


def kept_documents(
    docs: DataFrame, model: TextModel, languages: list[str] | None = None
) -> DataFrame:
    """The documents whose language is identified and, if ``languages`` are given, among them."""
    mark = free_name(docs, "_verdict")
    verdicts = _document_verdicts(docs, model, languages)
    row = free_name(docs, "_row")
    text_key = _row_key(docs)
    bad = verdicts.filter("NOT kept").select(F.col("key").alias(mark)).distinct()
    # rejected rows are few; those kept are not joined by hot values as keys are near unique
    return (
        docs.withColumn(row, text_key)
        .join(bad, F.col(row) == F.col(mark), "left_anti")
        .select(*docs.columns)
    )


def _row_key(docs: DataFrame) -> Column:
    """Rows with equal keys have equal evidence, so they get one verdict."""
    return row_key("doc_id", F.xxhash64("text", "source"))


def _document_verdicts(docs: DataFrame, model: TextModel, languages=None) -> DataFrame:
    found = identify(document_records(docs, _row_key(docs)), model)
    return found.withColumn("kept", accepted(languages))


def document_languages(docs: DataFrame) -> DataFrame:
    """Per document: its language, the confidence, and whether the operator accepts it."""
    model = train(known_texts(docs))
    found = identify(document_records(docs, F.struct("doc_id")), model)
    return found.select("key.doc_id", "language", "confidence", accepted().alias("kept"))


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Per page: its language by all evidence; the text model is learnt from the documents."""
    model = train(known_texts(docs))
    found = identify(page_records(pages), model, markup=True)
    return found.select("key.page_id", "language", "confidence", accepted().alias("kept"))
