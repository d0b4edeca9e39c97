import time
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, pii

from .data import frame, prose, texts


def brute_base(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def test_base_spans():
    r = random.Random(7)
    for _ in range(6000):
        text = "".join(r.choice(["1", "25", "4111111111111111", ".", "@", "a", "-", " ", "+1", "(555)", "b.c", "x_%", "é", "\n", "0", "378282246310005", ")"]) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_personal(spark):
    r = random.Random(8)
    found = [f"{prose(r, 4)} member mail u{i}@site{i}.org and {prose(r, 5)}" for i in range(30)]
    found += [f"reach host 10.0.0.{i} now, build 7.{i} done" for i in range(20)]
    found += ["write to member mail k.9(at)site.net please", "the build 7.77 is done", None, "", "1.2.3.4"]
    rows = sorted(pii.find_personal(frame(spark, found)).collect(), key=lambda x: x["doc_id"])
    assert [x["doc_id"] for x in rows] == list(range(len(found)))
    for x, t in zip(rows, found, strict=True):
        base = brute_base(t or "")
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert x["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(x["spans"].split(","))
    assert rows[51]["spans"] == "" and rows[51]["n_added"] == 0
    assert pii.find_personal(frame(spark, [])).count() == 0


def test_contexts_find_unseen(spark):
    found = [f"intro card number: {4111111111111111} tail{i}" if i == 0 else f"intro card number: {n} tail{i}" for i, n in enumerate(_cards(12))]
    found += ["intro card number: 4111111111111112 end", "free 4111111111111112 end"]
    rows = sorted(pii.find_personal(frame(spark, found)).collect(), key=lambda x: x["doc_id"])
    assert rows[12]["spans"] == "card:19:35" and rows[12]["n_card"] == 0 and rows[12]["n_added"] == 1
    assert rows[13]["spans"] == ""


def test_contexts_find_other_shapes(spark):
    """What no base pattern matches: no @, no +, spaces, letters alone, and up to a known word after."""
    r = random.Random(12)
    found = [f"{prose(r, 4)} member mail u{i}@site{i}.org and {prose(r, 5)}" for i in range(30)]
    found += [f"{prose(r, 4)} dial (+49 30 555{i:04}) tonight {prose(r, 5)}" for i in range(30)]
    planted = [("member mail ", "k.9(at)site.net", " please"), ("member mail ", "kurt", ", thanks"), ("my mail ", "kay at site dot net", " and so on"), ("now dial ", "030 555 12 34", ", or not"), ("dial (", "0049-30/1234567", ") tonight")]
    found += [a + b + c for a, b, c in planted] + ["mail order, post and so on, the mail", "a dial"]
    rows = sorted(pii.find_personal(frame(spark, found)).collect(), key=lambda x: x["doc_id"])
    for (a, b, _), x, kind in zip(planted, rows[60:], ["email"] * 3 + ["phone"] * 2, strict=False):
        assert f"{kind}:{len(a)}:{len(a) + len(b)}" in x["spans"].split(","), (b, x["spans"])
    assert rows[66]["spans"] == ""


def test_contexts_of_long_words():
    long = "w" * 300
    text = f"{long} mail u@site.org"
    (_, _, patterns), = pii.seeds(text, pii.base_spans(text))
    assert patterns == [pii.pattern_of(pii.BEFORE, "mail"), pii.pattern_of(pii.TWO, long, "mail")]
    contexts = pii.Contexts({x: (5, patterns[0]) for x in patterns})
    other = f"{long} mail {'k' * 500}(at)site.net"
    assert {(a, b) for a, b, _, _ in pii.unseen(other, [], contexts)} == {(306, len(other))}
    assert {x for *_, x in pii.unseen(other, [], contexts)} == set(patterns)


def _cards(n):
    made = (str(x) for x in range(4000000000000000, 4000000000001000))
    return [x for x in made if pii.luhn(x)][:n]


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute_tiles(p, t, least):
    """Greedy string tiling as it is defined: the longest first, ties by start in the pattern, then in the text."""
    free_p, free_t, tiles = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        free_p[i : i + n], free_t[j : j + n] = [False] * n, [False] * n
        tiles.append((i, j, n))


def test_tiles_match_brute_force():
    r = np.random.default_rng(4)
    several = 0
    for _ in range(600):
        p, t = (r.integers(0, r.choice([2, 3, 6]), r.integers(0, 40)).astype(np.uint64) for _ in range(2))
        tiles = decontaminate.greedy_tiles(p, t, 3)
        assert tiles == brute_tiles(p.tolist(), t.tolist(), 3)
        several += len(tiles) > 1
    assert several > 100


def test_tiles_of_repeated_words():
    """Neither a text of one word nor one of two in turn costs a square of its windows."""
    started = time.time()
    assert sum(n for _, _, n in decontaminate.greedy_tiles(np.full(60, 7, np.uint64), np.full(20_000, 7, np.uint64), 5)) == 60
    pair = np.array([1, 2] * 500, np.uint64)
    assert decontaminate.greedy_tiles(pair, np.tile(pair, 10), 5) == [(0, 0, 1000)]
    parts = np.concatenate([pair[: n + 10] for n in range(0, 100, 10)])
    assert sum(n for _, _, n in decontaminate.greedy_tiles(pair, parts, 5)) > 500
    assert time.time() - started < 20


def test_contaminated(spark):
    r = random.Random(10)
    items = [" ".join(f"item{k}w{i}" for i in range(30)) for k in range(6)] + ["", None, "tiny one"]
    clean = [prose(r, 50) for _ in range(30)]
    found = [*clean, *[c + " " + items[k].upper() + "! " + c for k, c in enumerate(clean[:6])], None, "", "a Tiny, one here"]
    w = items[2].split(" ")
    reordered, half = " ".join(w[20:] + ["zz"] + w[8:20] + ["yy"] + w[:8]), " ".join(w[:15])
    found += [prose(r, 10) + reordered, prose(r, 10) + half, " ".join(reversed(w))]
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, items[0])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((x["doc_id"], x["item_id"], x["covered"]) for x in decontaminate.contaminated(frame(spark, found), bench).collect())
    assert got == [(30 + k, k, 30) for k in range(6)] + [(38, 8, 2), (39, 2, 30)]
    kept = decontaminate.drop_contaminated(frame(spark, found), bench)
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(found))) - {30, 31, 32, 33, 34, 35, 38, 39}
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, found), bench.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = [" ".join(f"item{k}w{i}" for i in range(10)) for k in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, items), bench).collect()
    assert sorted((x["doc_id"], x["item_id"]) for x in got) == [(k, k) for k in range(5)]


WORDS = {"en": "the of and that with from this have", "de": "der die und das nicht mit sich auch", "fr": "le la les des que dans pour pas"}


def labelled(spark, n=90):
    r = random.Random(11)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        rows.append((i, " ".join(r.choices(WORDS[lang].split(), k=30)), lang, "src"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_pages(spark):
    rows, docs = labelled(spark)
    page = lambda text, lang, url: (f'<html lang="{lang}"><script>der die das</script><p>{text}</p>', url)
    made = [page(t, lang, f"https://h{i}.example.{lang}/x") for i, (_, t, lang, _) in enumerate(rows)]
    ambiguous = ("<p>xyzzy</p>", "https://h.sub.de/1")
    hosts = [page(WORDS["de"], "de", "https://h.sub.de/1") for _ in range(12)]
    made += [*hosts, ambiguous, (None, None), ("<p>123 456</p>", "nonsense"), ("", "")]
    pages = spark.createDataFrame([(i, u, h, 1) for i, (h, u) in enumerate(made)] + [(None, "", "", 1)], "page_id long, url string, html string, lang int")
    got = {x["page_id"]: x for x in language_id.page_languages(pages, docs).collect()}
    assert len(got) == len(made)
    assert all(got[i]["lang"] == lang and got[i]["accepted"] for i, (_, _, lang, _) in enumerate(rows))
    assert got[102]["lang"] == "de"  # the text says nothing; host, site and suffix do
    assert [got[i]["lang"] for i in (103, 104, 105)] == ["und"] * 3 and not got[103]["accepted"]
    assert language_id.page_languages(pages.limit(0), docs).count() == 0


def test_documents(spark):
    rows, docs = labelled(spark)
    more = docs.unionByName(spark.createDataFrame([(900, None, "en", "src"), (901, "?!", None, None), (None, "the", "en", "s")], docs.schema))
    kept = {x["doc_id"] for x in language_id.drop_rejected(more).collect()}
    assert kept == set(range(90))
    foreign = [(1, " ".join(["qzx", "xqj", "zzq"] * 40)), (2, WORDS["fr"])]
    fused = language_id.fuse(spark.createDataFrame([(i, t, None, None, None, None) for i, t in foreign], "id long, text string, declared string, suffix string, host string, site string"), language_id.fit(labelled(spark, 3000)[1]))
    assert {x["id"]: x["accepted"] for x in fused.collect()} == {1: False, 2: True}
    held_out = language_id.fit(docs.where("doc_id < 45"))
    right = [held_out.languages[int(np.argmax(held_out.scores(t)[0]))] == lang for _, t, lang, _ in rows[45:]]
    assert np.mean(right) > 0.97


def test_everything_on_edge_texts(spark):
    found = texts(12, 60)
    by = defaultdict(list)
    for x in language_id.document_languages(frame(spark, found)).collect():
        by[x["doc_id"]].append(x)
    assert sorted(by) == list(range(60)) and all(len(v) == 1 for v in by.values())
