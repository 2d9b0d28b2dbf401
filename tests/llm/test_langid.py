import math

import re

import numpy as np
from pyspark.sql import functions as F

from inferframe.llm import langid, queries


def test_agrees_with_declared_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(got) == 1000 and sum(r.rejected for r in got) == 0
    assert sum(r.lang == r.language for r in got) >= 995
    pages = queries.op3_language_id_pages(spark, "/root/testdata/sf0.01").collect()
    assert len(pages) == 250 and {r.language for r in pages} <= {"de", "en", "es", "fr"}


def codes(text):
    """Hashed byte trigrams, one byte at a time: letters in lower case, gaps for the rest, a gap on either side."""
    sound = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    framed = [32, *sound, 32]
    out = []
    for a, b, c in zip(framed, framed[1:], framed[2:]):
        if not a == b == c == 32:
            out.append(((a << 16 | b << 8 | c) * 0x9E3779B1 >> 11) & (2**14 - 1))
    return out


def plain(rows, languages=("de", "en", "es", "fr"), strength=20.0, evidence=40):
    """The same evidence, one row at a time."""
    n = len(languages)
    counts = np.zeros((n, 2**14))
    for text, said, _ in rows:
        if said in languages:
            np.add.at(counts[languages.index(said)], codes(text), 1)
    model = np.log((counts + 0.02) / (counts + 0.02).sum(axis=1, keepdims=True) * 2**14)
    mixed = np.log(0.98 * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * 2**14 + 0.02)
    lls, guesses = [], []
    for text, _, _ in rows:
        c = codes(text)
        ll = model[:, c].mean(axis=1) * min(len(c), evidence) if c else np.zeros(n)
        lls.append(ll)
        guesses.append(int(ll.argmax()) if c and mixed[:, c].mean(axis=1).max() > 0 else None)

    def tally(keys):
        out = {}
        for k, g in zip(keys, guesses):
            if k is not None and g is not None:
                out.setdefault(k, [0] * n)[g] += 1
        return out

    kind = [None if s is None else s if s in languages else "other" for _, s, _ in rows]
    said_n, kinds = tally(kind), [*languages, "other"]
    hosts = [h for _, _, h in rows]
    domains = [None if h is None else ".".join(h.split(".")[-2:]) for h in hosts]
    suffixes = [h.split(".")[-1] if h and "." in h else None for h in hosts]
    host_n, domain_n, suffix_n = tally(hosts), tally(domains), tally(suffixes)
    total = [1 + sum(g == i for g in guesses) for i in range(n)]
    result = []
    for i in range(len(rows)):
        p = [t / sum(total) for t in total]
        for table, key in ((domain_n, domains[i]), (host_n, hosts[i])):
            if key in table:
                size = sum(table[key])
                p = [(c + strength * q) / (size + strength) for c, q in zip(table[key], p)]
        score = [lls[i][k] + math.log(p[k]) for k in range(n)]
        for k in range(n):
            if kind[i]:
                score[k] += math.log((said_n.get(kind[i], [0] * n)[k] + 1) / (sum(v[k] for v in said_n.values()) + len(kinds)))
            if suffixes[i] in suffix_n:
                score[k] += math.log((suffix_n[suffixes[i]][k] + 1) / (total[k] + 1))
        top = max(score)
        e = [math.exp(s - top) for s in score]
        result.append(("und" if guesses[i] is None or max(e) / sum(e) < 0.5 else languages[e.index(max(e))], round(max(e) / sum(e), 4)))
    return result


def test_against_plain(spark):
    texts = [(r.text, r.lang, f"h{r.doc_id % 7}.{'ab'[r.doc_id % 2]}.{r.lang}") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    rows = [*texts, (None, None, None), ("", "en", "x"), ("12 34 !!", "fr", None), ("Ωμέγα ήταν κάτι άλλο τελείως", "el", "gr"), (texts[0][0], "xx", "h1"), (texts[0][0], "xx", "h1")]
    docs = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, where string, posterior string")
    got = {r.id: (r.language, r.posterior) for r in langid.identify_languages(docs, declared=F.col("lang"), host=F.col("where")).collect()}
    want = plain(rows)
    assert [got[i][0] for i in range(len(rows))] == [w[0] for w in want]
    assert all(abs(got[i][1] - w[1]) < 1e-3 for i, w in enumerate(want) if w[0] != "und")
    assert [w[0] for w in want[-6:-2]] == ["und"] * 4
    assert langid.identify_languages(docs.limit(0)).collect() == []


def test_pages_against_plain(spark):
    """The query over pages, with markup, host and text taken by other means."""
    pages = sorted((r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect())
    rows = []
    for _, url, html in pages:
        said = re.search(r"<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", html or "", re.I)
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", html or "")
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        rows.append((re.sub(r"<[^>]*>", " ", bare), said and said[1].lower(), re.split(r"[/?#]", rest)[0].lower()))
    got = {r.page_id: (r.language, r.posterior) for r in queries.op3_language_id_pages(spark, "/root/testdata/sf0.01").collect()}
    want = plain(rows)
    assert [got[i][0] for i, _, _ in pages] == [w[0] for w in want]
    assert all(abs(got[i][1] - w[1]) < 1e-3 for (i, _, _), w in zip(pages, want) if w[0] != "und")


def test_accuracy_where_nothing_is_declared(spark):
    """A third of the rows lose declaration and host, which teach nothing of them and say nothing for them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("said", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    hidden = docs.where("said IS NULL").count()
    got = langid.identify_languages(docs, declared=F.col("said"), host=F.when(F.col("said").isNotNull(), F.col("source")))
    rows = got.join(docs.select(F.col("doc_id").alias("id"), "lang", "said"), "id").where("said IS NULL").collect()
    assert len(rows) == hidden > 300
    assert sum(r.text_language == r.lang for r in rows) >= 0.99 * hidden and sum(r.language == r.lang for r in rows) >= 0.99 * hidden


def test_ties_go_to_the_first_language(spark):
    rows = spark.createDataFrame([(1, "abc abc", "fr"), (2, "abc abc", "es"), (3, "abc abc", None)], "doc_id long, text string, lang string")
    got = {r.id: r for r in langid.identify_languages(rows, declared=F.col("lang"), confidence=0.0).collect()}
    assert got[3].text_language == "es" and got[3].language == "es"


def test_markup(spark):
    pages = [('<HTML class="a" lang=\'fr\'><script>var t="</p>";</script>un<b>e</b><!-- <p> --> rue', "fr"), ("<html><p lang='de'>x", None), (None, None)]
    rows = spark.createDataFrame([(h,) for h, _ in pages], "html string").select(langid.page_declared(F.col("html")).alias("d"), langid.page_text(F.col("html")).alias("t")).collect()
    assert [r.d for r in rows] == [d for _, d in pages]
    assert rows[0].t.split() == ["un", "e", "rue"] and rows[2].t is None


def test_other_languages_are_rejected_at_every_size(spark):
    others = [
        "Il governo ha annunciato ieri che la nuova legge sarà discussa in parlamento la prossima settimana, mentre i cittadini aspettano ancora una risposta chiara sulle questioni economiche del paese.",
        "De regering heeft gisteren aangekondigd dat de nieuwe wet volgende week in het parlement wordt besproken, terwijl de burgers nog steeds wachten op een duidelijk antwoord over de economie van het land.",
        "O governo anunciou ontem que a nova lei será discutida no parlamento na próxima semana, enquanto os cidadãos ainda esperam uma resposta clara sobre as questões económicas do país.",
    ]
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
        rows = docs.union(spark.createDataFrame([(-1 - i, t, None, None) for i, t in enumerate(others)], docs.schema))
        gone = langid.identify_languages(rows, declared=F.col("lang"), host=F.col("source")).where("rejected").collect()
        assert sorted(r.id for r in gone) == [-3, -2, -1] and {r.language for r in gone} == {"und"}
