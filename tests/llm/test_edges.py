"""Repeated rows and empty tables for all operators; the fusion formula and the pipeline's stages against plain versions."""

import math
from functools import partial

import numpy as np
import pytest

from tessera.llm import decontaminate, exact_dedup, language_id, line_dedup, near_dedup, packing, pii, substring_dedup, token_count, token_store
from tessera.llm.common import Scratch
from tessera.llm.tokens import encoder

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LINE = "one line that is long enough to be a line of its own, with mail ann@example.org in it"


def stored(docs):
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'store').root}/store"
    token_store.write_store(docs, path, partial(encoder, P.path("word_bpe_49k.json"), 2), 49_408)
    return token_store.read_store(spark, path)


OPERATORS = {
    "packing": lambda docs: packing.pack_documents(docs, partial(encoder, P.path("byte_bpe_50k.json"), 2)),
    "contaminated": lambda docs: decontaminate.contaminated(docs, docs.where("doc_id = 1").selectExpr("doc_id AS item_id", "text").distinct()),
    "near": lambda docs: near_dedup.near_groups(docs, 2),
    "lines": line_dedup.dedup_lines,
    "personal": pii.find_personal,
    "exact": exact_dedup.exact_groups,
    "tokens": lambda docs: token_count.token_counts(docs, P.path("byte_bpe_50k.json")),
    "repeats": substring_dedup.remove_repeats,
    "store": stored,
    "language": language_id.document_languages,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_repeated_rows_and_empty_tables(spark, name):
    """(1, a) twice, (1, b), (2, a) and a null text: a row for each row, equal ones for equal rows."""
    a, b = LINE + "\nsecond", "something else, of other words altogether\n" + LINE
    rows = [(1, a, "en", "s", 1, "x"), (1, a, "en", "s", 1, "x"), (1, b, "en", "s", 1, "x"), (2, a, "en", "s", 1, "x"), (3, None, None, None, None, None)]
    got = [r.asDict() for r in OPERATORS[name](spark.createDataFrame(rows, SCHEMA)).collect()]
    if name == "contaminated":  # the two items are the texts of document 1, so each row of it is contaminated, and 2 is
        assert {r["doc_id"] for r in got} == {1, 2}
    else:
        assert sorted(r["doc_id"] for r in got) == [1, 1, 1, 2, 3]
    if name == "lines":  # the line stays once, wherever its first place is
        assert sum((r["text"] or "").count(LINE) for r in {(r["doc_id"], r["text"]): r for r in got}.values()) == 1
    if name == "personal":
        assert [r["n_email"] for r in sorted(got, key=lambda r: r["doc_id"])] == [1, 1, 1, 1, 0]
    if name == "packing":
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5
    if name == "store":
        got.sort(key=lambda r: r["start"])
        assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_fusion_formula(spark):
    """The posterior as its docstring says it, row by row."""
    texts = {"en": "the house and the river with some of the people", "de": "das haus und der fluss mit einigen der menschen", "fr": "la maison et la riviere avec quelques uns des gens"}
    rows = [(i, texts[lang] + " " + extra, declared, suffix, host, site) for i, (lang, extra, declared, suffix, host, site) in enumerate([
        ("en", "", "en", "org", "a.x.org", "x.org"), ("en", "again", None, "org", "a.x.org", "x.org"), ("de", "", "de", "de", "b.y.de", "y.de"), ("de", "wieder", "en", "de", "c.y.de", "y.de"),
        ("fr", "", "fr", None, None, None), ("fr", "encore", "fr", "fr", "d.z.fr", "z.fr"), ("en", "the", "fr", "fr", "d.z.fr", "z.fr")])] + [(99, "123", "de", "de", "b.y.de", "y.de")]
    labelled = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    made = language_id.fit(labelled)
    got = {r["id"]: r for r in language_id.fuse(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, site string"), made).collect()}
    k, scored = len(made.languages), {}
    for i, text, *_ in rows:
        logs, n, _ = made.scores(text)
        e = [math.exp(x - max(logs)) for x in logs]
        scored[i] = (logs, [x / sum(e) if n else 0.0 for x in e], n)
    total = [sum(scored[i][1][j] for i in scored) for j in range(k)]
    prior = [(t + 1) / (sum(total) + k) for t in total]
    for i, _, declared, suffix, host, site in rows:
        near = lambda at, value, j, i=i: sum(scored[r[0]][1][j] for r in rows if r[at] == value and r[0] != i) if value is not None else 0.0
        post = []
        for j in range(k):
            log = scored[i][0][j]
            for at, value in ((2, declared), (3, suffix)):
                if value is not None:
                    log += math.log((near(at, value, j) + language_id.TABLE_WEIGHT * prior[j]) / (total[j] + language_id.TABLE_WEIGHT))
            by = lambda at, value: [near(at, value, x) for x in range(k)]
            of_site, of_host = by(5, site), by(4, host)
            smooth = [(of_site[x] + language_id.SITE_WEIGHT * prior[x]) / (sum(of_site) + language_id.SITE_WEIGHT) for x in range(k)]
            post.append(log + math.log((of_host[j] + language_id.HOST_WEIGHT * smooth[j]) / (sum(of_host) + language_id.HOST_WEIGHT)))
        e = [math.exp(x - max(post)) for x in post]
        best = max(range(k), key=lambda j: e[j])
        assert got[i]["lang"] == (made.languages[best] if scored[i][2] else "und")
        assert got[i]["posterior"] == pytest.approx(e[best] / sum(e), abs=1e-9)


def test_sample_is_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "concat('text of words number ', id % 7) AS text", "'en' AS lang")
    counted = language_id.fit(rows, sample=500)
    assert counted.languages == ["en"]
    one = language_id.grams("text of words number 1")
    least = math.exp(counted.weights[one[0], 0])  # (n + 0.5) / (all + half of FEATURES), n of at most 500 rows
    assert 0 < least <= 500.5 / (500 * len(one) + language_id.FEATURES / 2) * 1.05


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.documents(spark, folder)
    scratch, kept = Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
        after = scratch.keep(stage(spark, docs, folder), "stage")
        kept[name] = (before, {r["doc_id"] for r in after.select("doc_id").collect()})
        if name != "packing":
            assert after.columns == docs.columns
            docs = after
    before, left = kept["exact dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(exact_words(before[i]), i)
    assert left == set(first.values())
    before, left = kept["near dedup"]
    sets = {i: shingles(t) for i, t in before.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert left == {i for i in sets if find(i) == i}
    before, left = kept["decontamination"]
    items = [w.copy() for w in decontaminate.words_of([r["text"] or "" for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]) if len(w)]
    texts = dict(zip(before, [w.copy() for w in decontaminate.words_of(list(before.values()))], strict=True))
    covered = lambda item, words: sum(n for _, _, n in decontaminate.greedy_tiles(item, words, min(5, len(item))))
    assert left == {i for i, w in texts.items() if not any(np.isin(item, w).sum() >= 0.6 * len(item) and covered(item, w) >= 0.6 * len(item) for item in items)}
    places = {}
    for r in scratch.keep(corpus_pipeline.packing(spark, docs, folder), "packed").collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 1024


def exact_words(text):
    """The text after each run of ASCII white space became one space."""
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text)


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
