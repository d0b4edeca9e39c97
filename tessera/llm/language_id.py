"""Language identification by Bayesian fusion of evidence.

For each language l the log posterior is the sum of

* text: a byte n-gram likelihood (hashed 4-grams), tempered, as neighbouring n-grams are far from independent;
* declared markup language: P(declared | l), from counts over all rows, each weighted by its text posterior;
* address suffix (the last label of the host): P(suffix | l), counted likewise;
* host: a prior P(l | host) smoothed towards P(l | site), itself smoothed towards P(l), all from grouped sums of text
  posteriors over all rows. A row's own posterior is taken out of its host's and site's sums.

Only the text model is fitted on a sample: at most SAMPLE labelled rows, chosen by a hash of their id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced

#: Labelled rows of the text model, at most; hashed n-grams; weight of the text evidence per n-gram, and its cap.
SAMPLE, FEATURES, TEMPER, MOST_GRAMS = 8_000, 1 << 16, 0.25, 400
#: Pseudo-counts: of a site's prior against the whole, of a host's against its site, and of the small tables.
SITE_WEIGHT, HOST_WEIGHT, TABLE_WEIGHT = 8.0, 4.0, 1.0
#: A row is accepted when its language's posterior is at least so much and its text isn't foreign to all languages.
ACCEPT, FOREIGN_GRAMS, FOREIGN_SCORE = 0.5, 60, -0.5

_SPACES = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def grams(text: str) -> np.ndarray:
    """Hashed byte 4-grams of the lower-cased letters of a text; other ASCII characters count as one space."""
    data = _SPACES.sub(b" ", text.lower().encode("utf-8", "surrogatepass")).strip()
    if not data:
        return np.empty(0, np.int64)
    x = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    if len(x) < 4:
        x = np.pad(x, (0, 4 - len(x)), constant_values=32)
    x = ((x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(16)).astype(np.int64)


class TextModel:
    """languages, and log P(n-gram | language) as an array of FEATURES rows; the last column is of all languages alike."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.weights = np.log(smooth / smooth.sum(axis=0))
        self.flat = -np.log(FEATURES)

    def scores(self, text: str) -> tuple[np.ndarray, int, float]:
        """(log likelihoods, tempered; n-grams; mean log likelihood of the best language over that of uniform n-grams)."""
        found = grams(text)
        if not len(found) or not self.languages:
            return np.zeros(len(self.languages)), 0, 0.0
        mean = self.weights[found].mean(axis=0)
        return TEMPER * min(len(found), MOST_GRAMS) * mean, len(found), float(mean.max() - self.flat)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> TextModel:
    """The text model of the rows' lang column (rows with null lang or doc_id aren't used)."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("at"))
    n = rows.count()
    chosen = rows
    if n > sample:  # the ids of least hash, as many as sample allows; some 2 * sample hashes come here to find where to stop
        below = -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 2 * sample / n))
        counts = rows.where(F.col("at") < F.lit(below)).groupBy("at").agg(F.count("*").alias("n")).toArrow().sort_by("at")
        within = np.flatnonzero(np.cumsum(counts.column("n").to_numpy()) <= sample)
        chosen = rows.where(F.col("at") <= F.lit(int(counts.column("at")[int(within[-1])].as_py()) if len(within) else -(1 << 63)))
    chosen = chosen.select("lang", "text")

    def count(found):
        total: dict[str, np.ndarray] = {}
        for batch in sliced(found):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.bincount(grams(text), minlength=FEATURES)
        for lang, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["lang", "gram", "n"])

    found = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((FEATURES, len(langs)))
    at = {lang: i for i, lang in enumerate(langs)}
    counts[found.column("gram").to_numpy(), [at[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return TextModel(langs, counts)


def _posterior(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _listed(x: np.ndarray):
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))


def fuse(rows: DataFrame, model: TextModel, name: str = "language") -> DataFrame:
    """rows: id long, text string, declared string, suffix string, host string, site string (all but id may be null:
    no such evidence). Returns id, lang, posterior, accepted; a row without any letters has lang 'und' and isn't accepted.
    """
    spark, languages, k = rows.sparkSession, model.languages, len(model.languages)
    if not k:
        return rows.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    scratch, shared = Scratch(spark, name), spark.sparkContext.broadcast(model)

    def score(found):
        for batch in sliced(found):
            scored = [shared.value.scores(t or "") for t in batch.column(1).to_pylist()]
            logs = np.array([s[0] for s in scored]).reshape(-1, k)
            evidence = [pa.array([s[1] for s in scored], pa.int64()), pa.array([s[2] for s in scored], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], _listed(logs), _listed(_posterior(logs)), *evidence], names)

    names = ["id", "declared", "suffix", "host", "site", "logs", "text_posterior", "n_grams", "known"]
    schema = "id long, declared string, suffix string, host string, site string, logs array<double>, text_posterior array<double>, n_grams long, known double"
    scored = scratch.keep(rows.select("id", "text", "declared", "suffix", "host", "site").mapInArrow(score, schema), "scored")
    sums = [F.sum(F.when(F.col("n_grams") > 0, F.col("text_posterior")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(k)]
    summed = lambda key: scored.where(F.col(key).isNotNull()).groupBy(key).agg(*sums).select(key, F.array(*[f"s{i}" for i in range(k)]).alias(f"{key}_sums"))
    whole = scored.agg(*sums).collect()[0]
    total = np.array([whole[i] or 0.0 for i in range(k)])
    prior = (total + 1.0) / (total.sum() + k)
    joined = scored
    for key in ("declared", "suffix", "site", "host"):
        joined = joined.join(summed(key), key, "left")

    def decide(found):
        for batch in found:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            if not n:
                continue
            table = lambda key: np.array([[0.0] * k if x is None else x for x in column[key].to_pylist()]).reshape(n, k)
            own, logs, n_grams = table("text_posterior"), table("logs"), column["n_grams"].to_numpy()
            own = own * (n_grams > 0)[:, None]
            for key in ("declared", "suffix"):  # P(value | l), by the counts without the row's own
                here = np.maximum(table(f"{key}_sums") - own, 0)
                there = ~np.equal(np.array(column[key].to_pylist(), object), None)
                logs = logs + there[:, None] * np.log((here + TABLE_WEIGHT * prior) / (total + TABLE_WEIGHT))
            site, host = (np.maximum(table(f"{x}_sums") - own, 0) for x in ("site", "host"))
            site_prior = (site + SITE_WEIGHT * prior) / (site.sum(axis=1, keepdims=True) + SITE_WEIGHT)
            logs = logs + np.log((host + HOST_WEIGHT * site_prior) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT))
            post = _posterior(logs)
            best = post.argmax(axis=1)
            top = post[np.arange(n), best]
            foreign = (n_grams >= FOREIGN_GRAMS) & (column["known"].to_numpy() < FOREIGN_SCORE)
            good = (n_grams > 0) & (top >= ACCEPT) & ~foreign
            lang = pa.array([languages[b] if g else "und" for b, g in zip(best, n_grams > 0, strict=True)])
            yield pa.RecordBatch.from_arrays([column["id"], lang, pa.array(top), pa.array(good)], ["id", "lang", "posterior", "accepted"])

    columns = ["id", "declared", "suffix", "logs", "text_posterior", "n_grams", "known", *(f"{x}_sums" for x in ("declared", "suffix", "site", "host"))]
    return joined.select(*columns).mapInArrow(decide, "id long, lang string, posterior double, accepted boolean")


def page_rows(pages: DataFrame) -> DataFrame:
    """The evidence in web pages (page_id, url, html): text without scripts, styles, comments and tags; the lang attribute
    of <html>, first subtag; the host's last label; the host; the site, which is its last two labels."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"&[#\w]+;", " ")
    known = lambda c: F.when(c != "", c)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("id"),
        text.alias("text"),
        known(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))).alias("declared"),
        known(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
        known(host).alias("host"),
        known(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("site"),
    )


def page_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, lang, posterior, accepted) of each page; labelled: documents with text and lang. Null or empty pages, and
    pages without letters, are 'und'; pages without page_id are left out; repeated rows give a row each."""
    return fuse(page_rows(pages), fit(labelled), "pages").withColumnRenamed("id", "page_id")


def document_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, posterior, accepted) of each document: its text, its declared language (lang) and its source, which
    stands for the host. Without letters: 'und', not accepted."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("site")
    )
    return fuse(rows, fit(docs), "documents").withColumnRenamed("id", "doc_id")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that are accepted: with letters, not foreign to all known languages, and sure enough."""
    from .common import BROADCAST_IDS

    scratch = Scratch(docs.sparkSession, "language-drop")
    gone = scratch.keep(document_languages(docs).where(~F.col("accepted")).select("doc_id").distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
