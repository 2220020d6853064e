"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams, fitted on a bounded sample of
labelled rows (`sample_rows`, a parameter).  The declared markup language counts
by how far declarations are trusted; the address suffix and the host enter as
priors: posteriors of the texts are summed per host, per suffix and over all by
grouped aggregation, and each level is smoothed by the one above it.  A row's own
share is taken out of its host's sum, so it is no evidence for itself.

Defined results: a null or empty text, or one without a letter, has no text
evidence; its language then comes from the declaration and the priors, and it is
not accepted.  Nor is a text whose trigrams without digits are, in the likeliest
language, less likely than if all were alike (gibberish and languages outside the
set), or are under a tenth of all.  A text under three bytes has no trigram to go by, and
a sample of fewer trigrams than buckets rejects no text so.  A null or unknown declaration, suffix or host is no evidence.
Repeated rows get a row each; an empty table gives no rows; without any labelled
row there is no language to tell, and all languages are null and not accepted.  Of languages
that tie the first by name is told; columns other than those named are not read, or handed on
by the pipeline's stage; texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_views, settle
from .html_text import render

BUCKETS = 1 << 16
#: A text's evidence counts as that of this many trigrams at most, since neighbours depend on each other.
EVIDENCE = 200.0
#: The share of each language's likelihood that is spread over all buckets alike.
SPREAD = 0.02
#: The least mean log-likelihood a trigram, against all being alike, that counts as known text.
FLOOR = 0.0
#: The least share of trigrams without a digit; what is figures all over tells no language.
WORDED = 0.1
_STRIDE = np.uint32(0x9E3779B1)


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """A bucket for each three neighbouring bytes; A-Z counts as a-z."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    with np.errstate(over="ignore"):
        codes = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * _STRIDE
    return codes >> np.uint32(16)


class Model:
    """Log-likelihoods of the trigram buckets by language, each against all buckets being alike."""

    def __init__(self, languages: list[str], ratios: np.ndarray, trigrams: int):
        self.languages, self.ratios, self.trigrams = languages, ratios, trigrams

    @classmethod
    def fit(cls, texts: list[str | None], labels: list[str]) -> Model:
        languages = sorted(set(labels))
        counts = np.zeros((len(languages), BUCKETS))
        for text, label in zip(texts, labels):
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            if len(data) > 2:
                counts[languages.index(label)] += np.bincount(trigram_buckets(data), minlength=BUCKETS)
        # what no language has seen speaks for none, whatever their samples' sizes
        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return cls(languages, np.log((1 - SPREAD) * BUCKETS * shares + SPREAD).T.astype(np.float32).copy(), int(counts.sum()))

    def scores(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tempered log-likelihoods by language, whether it has a letter, and whether it is known text."""
        size = len(offsets) - 1
        out, letters, known = np.zeros((size, len(self.languages))), np.zeros(size, bool), np.ones(size, bool)
        letter, digit = np.zeros(256, bool), np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        digit[48:58] = True
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            letters[i] = letter[data[a:b]].any()
            if b - a > 2:
                total, n = np.zeros(len(self.languages)), b - a - 2
                worded, w = np.zeros(len(self.languages)), 0
                for at in range(a, b - 2, 1 << 16):  # pieces of one text; all of it counts
                    piece = data[at : min(b, at + (1 << 16) + 2)]
                    each, plain = self.ratios[trigram_buckets(piece)], ~digit[piece]
                    plain = plain[:-2] & plain[1:-1] & plain[2:]
                    total += each.sum(axis=0, dtype=np.float64)
                    worded += plain.astype(np.float32) @ each
                    w += int(plain.sum())
                out[i] = total / n * min(n, EVIDENCE)
                known[i] = self.trigrams < BUCKETS or w >= WORDED * n and worded.max(initial=-np.inf) / w >= FLOOR
        return out, letters, known


def fit_sample(labelled: DataFrame, sample_rows: int) -> Model:
    """A model from about sample_rows rows (text, label), chosen by a hash of their text."""
    labelled = labelled.where(F.col("label").isNotNull())
    n = labelled.count()
    share = min(1.0, sample_rows / max(n, 1))
    pick = F.pmod(F.xxhash64("text", "label"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    rows = labelled.where(pick | F.lit(share >= 1.0)).limit(2 * sample_rows).collect()
    return Model.fit([r.text for r in rows], [r.label for r in rows])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def markup_language(html: Column) -> Column:
    """The primary subtag of the lang attribute of the html element."""
    return F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]+)", 1))


def identify(rows: DataFrame, model: Model, trust: float = 0.9, weight: float = 20.0, least: float = 0.5) -> DataFrame:
    """rows (id, text, declared, suffix, host) with lang, confidence, text_lang and accepted; the text is not kept.

    id may be of any type.  weight: how many rows of the level above a host or suffix is smoothed by.
    """
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            logs, letters, known = model.scores(offsets, data)
            odds = np.exp(logs - logs.max(axis=1, keepdims=True, initial=-np.inf)) if names else logs
            shares = odds / odds.sum(axis=1, keepdims=True) if names else odds
            as_list = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), max(len(names), 1)).cast(pa.list_(pa.float64())) if names else pa.array([[]] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "declared", "suffix", "host")), as_list(logs), as_list(shares), pa.array(letters), pa.array(known)], names=["id", "declared", "suffix", "host", "logs", "shares", "letters", "known"])

    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.lower(F.trim(F.col(c))))
    rows = rows.select("id", F.col("text").cast("string").alias("text"), blank("declared").alias("declared"), blank("suffix").alias("suffix"), blank("host").alias("host"))
    told = settle(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, declared string, suffix string, host string, logs array<double>, shares array<double>, letters boolean, known boolean"))
    if not names:
        return told.select("id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("accepted"), "declared")
    size = range(len(names))
    own = [F.when(F.col("letters"), F.col("shares")[i]).otherwise(F.lit(0.0)) for i in size]
    sums = lambda: [F.sum(o).alias(f"s{i}") for i, o in enumerate(own)] + [F.sum(F.col("letters").cast("double")).alias("n")]
    everything = told.agg(*sums()).first()
    total = everything["n"] or 0.0
    overall = [((everything[f"s{i}"] or 0.0) + 1.0) / (total + len(names)) for i in size]

    by_suffix = told.where(F.col("suffix").isNotNull()).groupBy("suffix").agg(*sums())
    by_suffix = by_suffix.select(F.col("suffix").alias("x_suffix"), F.array(*((F.col(f"s{i}") + weight * overall[i]) / (F.col("n") + weight) for i in size)).alias("above"))
    by_host = told.where(F.col("host").isNotNull()).groupBy("host").agg(F.min("suffix").alias("x"), *sums())
    by_host = by_host.join(by_suffix, F.col("x") == F.col("x_suffix"), "left")
    above = F.coalesce("above", F.array(*map(F.lit, overall)))
    by_host = by_host.select(F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.array(*(F.col(f"s{i}") for i in size)).alias("h_s"), above.alias("h_above"))

    joined = told.join(by_host, F.col("host") == F.col("h_host"), "left")
    fused = []
    for i, name in enumerate(names):
        mine = F.col("letters").cast("double")
        prior = (F.col("h_s")[i] - own[i] + weight * F.col("h_above")[i]) / (F.col("h_n") - mine + weight)
        prior = F.greatest(F.coalesce(prior, F.lit(overall[i])), F.lit(1e-9))
        other = math.log((1 - trust) / max(len(names) - 1, 1)) if len(names) > 1 else 0.0
        said = F.when(F.col("declared") == name, math.log(trust)).when(F.col("declared").isin(names), other).otherwise(0.0)
        fused.append(F.col("logs")[i] + F.log(prior) + said)
    out = joined.select("id", "declared", "letters", "known", "shares", F.array(*fused).alias("fused"))
    top = F.array_max("fused")
    pick = lambda values, best: F.element_at(F.array(*map(F.lit, names)), F.array_position(values, best).cast("int"))
    sure = F.lit(1.0) / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("fused")))
    return out.select(
        "id",
        pick(F.col("fused"), top).alias("lang"),
        sure.alias("confidence"),
        F.when(F.col("letters"), pick(F.col("shares"), F.array_max("shares"))).alias("text_lang"),
        (F.col("letters") & F.col("known") & (sure >= least)).alias("accepted"),
        "declared",
    )


def of_documents(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, declared, text_lang, lang, confidence, accepted); the source stands for the host.

    The lang column labels the sample; so it is shown as declared, but it is no evidence.
    """
    model = fit_documents(docs, sample_rows)
    key = F.struct(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("lang")).alias("id")
    found = identify(document_rows(docs, key), model)
    return found.select(F.col("id.id").alias("doc_id"), F.col("id.lang").alias("declared"), "text_lang", "lang", "confidence", "accepted")


def fit_documents(docs: DataFrame, sample_rows: int) -> Model:
    return fit_sample(docs.select(F.col("text").cast("string").alias("text"), F.lower(F.trim("lang")).alias("label")), sample_rows)


def document_rows(docs: DataFrame, key: Column) -> DataFrame:
    return docs.select(key, F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("declared"), suffix_of(F.col("source")).alias("suffix"), F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame, key: Column) -> DataFrame:
    """Pages by the text that they show, with what their markup declares and their addresses."""
    host = host_of(F.col("url"))
    told = pages.select(key, markup_language(F.col("html")).alias("declared"), suffix_of(host).alias("suffix"), host.alias("host"), F.col("html").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array([render(x) for x in batch.column(at).to_pylist()], pa.string()))

    return told.mapInArrow(run, told.schema).select("id", "text", "declared", "suffix", "host")


def of_pages(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, lang, confidence, text_lang, accepted, declared) of web pages."""
    found = identify(page_rows(pages, F.col("page_id").cast("long").alias("id")), model)
    return found.withColumnRenamed("id", "page_id")


def of_both(docs: DataFrame, pages: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """(doc_id, page_id, declared, text_lang, lang, confidence, accepted): every document and every page, one id of the two each."""
    model = fit_documents(docs, sample_rows)
    none = F.lit(None).cast("long")
    lang = lambda c: c.cast("string").alias("lang")
    key = lambda doc, page, said: F.struct(doc.alias("doc"), page.alias("page"), lang(said)).alias("id")
    of_docs = document_rows(docs, key(F.col("doc_id").cast("long"), none, F.col("lang")))
    of_web = page_rows(pages, key(none, F.col("page_id").cast("long"), markup_language(F.col("html"))))
    found = identify(of_docs.union(of_web), model)
    return found.select(F.col("id.doc").alias("doc_id"), F.col("id.page").alias("page_id"), F.nullif(F.lower(F.trim("id.lang")), F.lit("")).alias("declared"), "text_lang", "lang", "confidence", "accepted")


def keep_identified(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """The documents whose language is told; lang becomes what was found.  Ids may be null or repeated."""
    # all that a row is judged by; rows of one key are judged alike
    key = F.xxhash64(F.struct("doc_id", "text", "source"))
    found = identify(document_rows(docs, key.alias("id")), fit_documents(docs, sample_rows)).where("accepted")
    found = found.groupBy(F.col("id").alias("f_key")).agg(F.max_by("lang", "confidence").alias("f_lang"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    joined = rows.join(found, F.col("key") == F.col("f_key"))
    return joined.select(F.col("row").withField("lang", F.col("f_lang")).alias("row")).select("row.*")
