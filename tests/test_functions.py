import base64
import random
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inferframe.functions import data_url as urls
from inferframe.functions import template as tpl
from inferframe.functions import text as tx
from inferframe.operators import similarity


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def plain_tokens(text):
    text = re.sub(r"!\[.*?\]\(.*?\)", " ", re.sub(r"</?[a-zA-z_]+\s*/?>", " ", text or ""))
    return [t.lower() for t in re.findall(r"\b\w+\b", text) if not re.match(r"^_+$", t)]


def plain_jaccard(a, b):
    a, b = (pd.Series(plain_tokens(x)).value_counts() if plain_tokens(x) else pd.Series(dtype=int) for x in (a, b))
    keys = set(a.index) | set(b.index)
    union = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / union if union else 1.0


TEXTS = ["", "a", "A b a", "<b>bold</b> <br/> x_y __ ___", "![img](http://x.y/z) caption", "Größe naïve ÉCOLE été", "日本 語 123", "a a a b c", None, "<td class='x'>c</td>"]


def test_tokens_and_similarity(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices(["a", "b", "cc", "<i>", "_", "É"], k=rng.randrange(12))) for _ in range(40)]
    pairs = [(i, a, texts[(i * 7 + 3) % len(texts)]) for i, a in enumerate(texts)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    given = F.col("a").isNotNull() & F.col("b").isNotNull()
    found = similarity.compare_texts(df.withColumn("t", tx.tokens(F.col("a"))), F.col("a"), F.col("b"), given, lists=True).collect()
    assert len(found) == len(pairs)
    for r in found:
        assert r.t == plain_tokens(r.a)
        if r.a is None or r.b is None:
            assert r.jaccard is None and r.diff is None and r.n_added is None
            continue
        assert r.jaccard == pytest.approx(plain_jaccard(r.a, r.b)) and 0 <= r.jaccard <= 1
        a, b = pd.Series(plain_tokens(r.a)).value_counts().to_dict(), pd.Series(plain_tokens(r.b)).value_counts().to_dict()
        assert r.diff.removed == sorted(set(a) - set(b)) and r.diff.added == sorted(set(b) - set(a)) and r.diff.changed == sorted(k for k in set(a) & set(b) if a[k] != b[k])
        assert (r.n_removed, r.n_changed, r.n_added) == tuple(map(len, r.diff))


def test_comparison_of_long_and_repeated_texts(spark):
    """Texts of 20,000 different words, the same pair in many rows, and both sides the same: one row for each row."""
    words = [f"w{i}" for i in range(20000)]
    a, b = " ".join(words), " ".join(words[5000:] + ["new"] * 3)
    rows = [(1, a, b), (2, a, a), (3, "", ""), (4, "", "x")] + [(i, "p q q", "q r") for i in range(5, 305)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(4)
    got = {r.i: r for r in similarity.compare_texts(df, F.col("a"), F.col("b"), F.lit(True)).collect()}
    assert len(got) == len(rows)
    assert (got[1].jaccard, got[1].n_removed, got[1].n_changed, got[1].n_added) == (15000 / 20003, 5000, 0, 1)
    assert got[2].jaccard == got[3].jaccard == 1.0 and got[4].jaccard == 0.0
    assert {(got[i].jaccard, got[i].n_removed, got[i].n_changed, got[i].n_added) for i in range(5, 305)} == {(1 / 4, 1, 1, 1)}


def test_comparison_where_the_row_is(spark, tmp_path):
    """Neither texts nor tokens are shuffled; letters whose lower case depends on what is beside them, runs of underscores, many pieces of a batch, and files."""
    odd = ["ΟΔΟΣ ΣΑΣ'Σ Σ_Σ", "İI ıi DŽ ǅ", "__ _a_ ___ a__ _", "_" * 3000, "<A_b/><a_b>x</c >![a](b)_ y", "naïve\u0301 É e\u0301 \u00a0 \u2028 ½ ٣"]
    texts = odd + [f"{x} {y}" for x in odd for y in odd] + [" ".join(f"w{j % (i + 2)}" for j in range(40_000)) for i in range(8)]
    df = spark.createDataFrame([(i, a, texts[(i * 5 + 2) % len(texts)]) for i, a in enumerate(texts)], "i int, a string, b string")
    both = df.select("*", tx.tokens(F.col("a")).alias("t"), F.split(tx.token_line(F.col("a")), " ").alias("line"), tx.tokens(F.col("b")).alias("u"))
    found = similarity.compare_texts(both, F.col("a"), F.col("b"), F.lit(True), lists=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert r.t == [x for x in r.line if x.strip("_")]
        a, b = Counter(r.t), Counter(r.u)
        assert r.jaccard == ((a & b).total() / (a | b).total() if a | b else 1.0)
        assert tuple(r.diff) == (sorted(set(a) - set(b)), sorted(k for k in a if k in b and a[k] != b[k]), sorted(set(b) - set(a)))
    for i, text in enumerate(odd):
        (tmp_path / str(i)).write_text(text)
    spark.range(36).select(F.concat(F.lit(f"{tmp_path}/"), F.col("id") % 6).alias("p"), F.concat(F.lit(f"{tmp_path}/"), F.floor(F.col("id") / 6)).alias("q")).repartition(8).write.parquet(str(tmp_path / "paths"))
    got = similarity.compare_paths(spark.read.parquet(str(tmp_path / "paths")), "p", "q")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 36 and got.where("p = q and jaccard = 1").count() == 6


def some_sides(seed, n=120, m=40):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choices(common, k=k) + rng.choices(rare, k=k))
    right = [(j, text(rng.randint(1, 12))) for j in range(m)] + [(m, ""), (m + 1, None)]
    left = [(i, text(rng.randint(0, 15))) for i in range(n)] + [(n + i, right[i][1]) for i in range(10)] + [(n + 10 + i, right[i][1] + " more c1") for i in range(10)] + [(n + 20, None), (n + 21, "nothing"), (n + 22, "c1")]
    return left, right


def plain_best(left, right):
    out = {}
    for i, a in left:
        best = (0.0, None)
        for j, b in right:
            shared = set(plain_tokens(a)) & set(plain_tokens(b))
            if shared and (s := plain_jaccard(a, b)) > best[0]:
                best = (s, j)
        out[i] = (best[1], pytest.approx(best[0]))
    return out


def test_best_match_both_ways(spark, monkeypatch):
    """The small right side at the tasks and the search by rising prefixes find the same, ties to the smaller id."""
    left, right = some_sides(7)
    want = plain_best(left, right)
    l = spark.createDataFrame(left, "i long, text string").withColumn("source", F.lit("s")).repartition(3)
    r = spark.createDataFrame(right, "j long, text string")
    got = similarity.best_match(l, r, "i", "j", keep=("source",))
    assert got.columns == ["i", "source", "j", "jaccard"]
    assert {x.i: (x.j, x.jaccard) for x in got.collect()} == want
    monkeypatch.setattr(similarity, "BROADCAST_TOKENS", 0)
    got = similarity.best_match(l, r, "i", "j", keep=("source",))
    assert {x.i: (x.j, x.jaccard) for x in got.collect()} == want
    none = spark.createDataFrame([], "j long, text string")
    monkeypatch.undo()
    assert {(x.j, x.jaccard) for x in similarity.best_match(l, none, "i", "j").collect()} == {(None, 0.0)}
    assert similarity.best_match(l.limit(0), r, "i", "j").count() == 0


def test_search_adds_up_few_of_all_pairs(spark):
    """Where most rows have a near one, the rounds add up a few pairs of those that share a token, and all rows are right."""
    left, right = some_sides(9, n=10, m=150)
    rng = random.Random(1)
    left += [(1000 + i, " ".join(t.split() + [f"x{i}"])) for i, t in enumerate(rng.choice(right[:150])[1] for _ in range(300))]
    l, r = spark.createDataFrame(left, "i long, text string"), spark.createDataFrame(right, "j long, text string")
    every = similarity.pair_similarity(l, r, "i", "j").count()
    found, added = similarity.search_best(l, r, "i", "j")
    want = {i: v for i, v in plain_best(left, right).items() if v[0] is not None}
    assert {x.i: (x.j, x.jaccard) for x in found.collect()} == want
    assert len(added) == len(similarity.FALLING) + 1 and sum(added) < every / 4


def test_highlight_never_marks_its_own_markup(spark):
    rows = [("A span of class text", ["span"], ["class", "a"]), ("x_1 Été, <b>x</b> & y", ["été", "b", "y"], ["y"]), (None, ["a"], []), ("a b", None, None), ("", [], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c array<string>, a array<string>").orderBy("i")
    shown = df.select(tx.highlight(F.col("t"), F.col("c"), F.col("a")).alias("h"))
    assert [r.h for r in shown.collect()] == [
        '<span class="added">A</span> <span class="changed">span</span> of <span class="added">class</span> text',
        'x_1 <span class="changed">Été</span>, <<span class="changed">b</span>>x</<span class="changed">b</span>> & <span class="added">y</span>',
        None, "a b", "",
    ]
    assert "Python" not in shown._jdf.queryExecution().toString() and "Arrow" not in shown._jdf.queryExecution().toString()


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.999, 0.994, 0.95, 0.9449, 0.9, 0.895, 0.8, 0.79, 0.0, None)], "x double")
    assert [r[0] for r in df.select(tx.similarity_band(F.col("x"))).collect()] == ["100", "100", "95", "95", "90", "90", "90", "80", "00", "00", None]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a\f\f",), ("\f",), ("a",), ("",), ("  ",)], "t string")
    assert [r[0] for r in df.select(tx.strip_form_feed(F.col("t"))).collect()] == ["a\f", "", "a", "", "  "]
    assert [r[0] for r in df.select(tx.is_blank(F.col("t"))).collect()] == [False, True, False, True, True]
    lines = spark.createDataFrame([("Syntax Error: x",), ("Syntax Error: Xref num 3",), ("fine",), ("ERROR",)], "t string")
    assert [r[0] for r in lines.select(tx.is_error_line(F.col("t"))).collect()] == [True, False, False, True]
    runs = spark.createDataFrame([(0, "ok"), (1, ""), (0, "a\nerror: b"), (0, "error: xref num 1\n"), (0, None)], "c int, e string")
    assert [r[0] for r in runs.select(tx.command_failed(F.col("c"), F.col("e"))).collect()] == [False, True, True, False, False]
    status = spark.createDataFrame([(s,) for s in (429, 500, 502, 503, 504, 400, None)], "s int")
    assert [r[0] for r in status.select(tx.http_transient(F.col("s"))).collect()] == [True, False, True, True, True, False, True]


def test_data_urls(spark):
    content = bytes(range(256)) * 3
    df = spark.createDataFrame([("image/png", content), ("a/b", b"x")], "m string, c binary")
    got = df.select("m", "c", urls.data_url(F.col("m"), F.col("c")).alias("u")).withColumn("p", urls.parse_data_url(F.col("u"))).collect()
    for r in got:
        assert r.u == f"data:{r.m};base64,{base64.b64encode(r.c).decode()}" and r.p.mime_type == r.m and bytes(r.p.data) == bytes(r.c)
    bad = spark.createDataFrame([("data:;base64,",), ("http://x",)], "u string")
    assert [r[0] for r in bad.select(urls.parse_data_url(F.col("u"))).collect()] == [None, None]
    uris = spark.createDataFrame([("s3://b/k/x",), ("s3://b/",), ("s3://b",), ("gs://b/k",)], "u string")
    assert [r[0] and tuple(r[0]) for r in uris.select(urls.parse_s3_uri(F.col("u"))).collect()] == [("b", "k/x"), ("b", ""), None, None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_characters="{}"), max_size=40))
def test_template_without_placeholders_is_itself(text):
    assert tpl.render(text, {"x": 1}) == text


def bindings_of(spark):
    from inferframe.operators.chat import bindings

    df = spark.sql("SELECT 'Jo' AS name, 3 AS n, 2.5D AS x, CAST(NULL AS STRING) AS gone, named_struct('b', 'deep', 'l', array(1, 2)) AS a, true AS yes, 'p\"q' AS q, 'i' AS id")
    return df, bindings(df)


@pytest.mark.parametrize(
    "template, want",
    [
        ("Hi {{name}}!", "Hi Jo!"), ("{{ n }}|{{x}}|{{yes}}|{{gone}}|{{nope}}|{{id}}", "3|2.5|true|||"), ("{{a.b}} {{a}}", 'deep {"b":"deep","l":[1,2]}'), ("{{{q}}}{{!-- c --}}{{! d }}", 'p"q'),
        ("{{concat name '-' n}}", "Jo-3"), ("{{to-string name}} {{to-string q}} {{to-string n}} {{to-string nope}}", '"Jo" "p\\"q" 3 null'), ("", ""), ("plain", "plain"), ("<&>", "<&>"),
    ],
)
def test_compiled_templates(spark, template, want):
    df, b = bindings_of(spark)
    assert df.select(tpl.compile_template(template, b)).first()[0] == want
    row = {"name": "Jo", "n": 3, "x": 2.5, "gone": None, "a": {"b": "deep", "l": [1, 2]}, "yes": True, "q": 'p"q'}
    assert tpl.render(template, row) == want


def test_blocks_and_errors():
    row = {"items": [{"n": 1}, {"n": 2}], "ok": True, "none": [], "o": {"k": "v"}}
    assert tpl.render("{{#each items}}{{@index}}:{{n}},{{/each}}", row) == "0:1,1:2,"
    assert tpl.render("{{#if ok}}y{{else}}n{{/if}}{{#unless ok}}y{{else}}n{{/unless}}", row) == "yn"
    assert tpl.render("{{#each none}}x{{else}}empty{{/each}}{{#with o}}{{k}}{{/with}}", row) == "emptyv"
    assert tpl.has_blocks("{{#if x}}{{/if}}") and not tpl.has_blocks("{{x}}")
    assert tpl.variables("{{#each items}}{{a.b}}{{/each}}{{concat x 'y'}}") == {"items", "a", "x"}
    for bad in ("{{#if x}}", "{{/if}}", "{{#loop x}}{{/loop}}", "{{shout x}}", "{{}}", "{{else}}"):
        with pytest.raises(tpl.TemplateError):
            tpl.parse(bad)


def test_file_helpers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 100
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "a.txt").write_text("héllo")

    def read(path):
        return open(path, "rb").read()

    assert tpl.render("{{text-file-contents p}}", {"p": str(tmp_path / "a.txt")}, read) == "héllo"
    assert tpl.render("{{image-data-url p}}", {"p": str(tmp_path / "a.png")}, read) == "data:image/png;base64," + base64.b64encode(png).decode()
    with pytest.raises(tpl.TemplateError):
        tpl.render("{{image-data-url p}}", {"p": str(tmp_path / "a.txt")}, read)
    files = spark.createDataFrame([(str(tmp_path / "a.png"), png)], "path string, content binary")
    from inferframe.sources.files import attach_files

    df = attach_files(spark.createDataFrame([(str(tmp_path / "a.png"),)], "p string"), F.col("p"), files)
    got = df.select(tpl.compile_template("{{image-data-url p}}", lambda path: (F.col(path[0]), F.col(path[0])), lambda p: F.col("content"))).first()[0]
    assert got.startswith("data:image/png;base64,iVBOR")
    with pytest.raises(Exception, match="no such file"):
        attach_files(spark.createDataFrame([("/nope",)], "p string"), F.col("p"), files).collect()


def test_tool_warnings_keep_digits_and_lose_spaces(spark):
    df = spark.createDataFrame([("0 a 0\n1 b 1\n\n  2 c  \n   \n13 d 31",), (None,)], "output string")
    got = [r.w for r in df.select(tx.tool_warnings(df.output).alias("w")).collect()]
    assert got == [["0 a 0", "1 b 1", "2 c", "13 d 31"], None]


@pytest.mark.parametrize("threshold", [None, 0.2])
def test_pairs_meet_postings_and_joins_alike(spark, monkeypatch, threshold):
    """All pairs that share a token: at the tasks, a few lists and postings at a time and with no shuffle of the left side, and by joins."""
    left, right = some_sides(3)
    want = {(i, j): pytest.approx(plain_jaccard(a, b)) for i, a in left for j, b in right if set(plain_tokens(a)) & set(plain_tokens(b)) and plain_jaccard(a, b) >= (threshold or 0)}
    l, r = spark.createDataFrame(left, "i long, text string"), spark.createDataFrame([*right, (None, "c1")], "j long, text string")
    monkeypatch.setattr(similarity, "HELD_TOKENS", 20)
    monkeypatch.setattr(similarity, "HELD_POSTINGS", 30)
    found = similarity.pair_similarity(l, r, "i", "j", threshold=threshold)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(x.i, x.j): x.jaccard for x in found.collect()} == want and len(want) > 10
    assert all(x.jaccard == x.inter / x.uni for x in found.collect())
    monkeypatch.setattr(similarity, "BROADCAST_TOKENS", 0)
    assert {(x.i, x.j): x.jaccard for x in similarity.pair_similarity(l, r, "i", "j", threshold=threshold).collect()} == want


def test_a_task_holds_few_postings():
    """However long the batch: slices end at HELD_TOKENS and HELD_POSTINGS, and cover all lists once."""
    right = pd.DataFrame([(j, f"t{k}", 1) for j in range(400) for k in range(j % 7, 60, 3)], columns=["j", "token", "m"])
    postings = similarity._Postings(right, "j")
    lists = pa.array([[f"t{k}" for k in range(60)] * 3] * 500 + [[]] * 50 + [["t1"]] * 3000)
    parts = list(postings.pairs(lists))
    assert [a for a, *_ in parts] == [0] + [b for _, b, *_ in parts][:-1] and parts[-1][1] == len(lists)
    most = max(len(x) for _, _, x, *_ in parts)
    assert len(parts) > 3 and most <= similarity.HELD_POSTINGS and sum(len(x) for _, _, x, *_ in parts) == 500 * 400 + 3000 * sum("t1" in set(g) for _, g in right.groupby("j").token)


def test_files_are_opened_where_their_rows_are(spark, tmp_path, monkeypatch):
    """No listing, no join: a row's file goes in its row, however many are held at once, and a missing one fails the run."""
    from inferframe.sources import files

    monkeypatch.setattr(files, "READ_BYTES", 10)
    rows = [(i, str(tmp_path / f"{i}.txt"), "old") for i in range(30)]
    for i, path, _ in rows:
        (tmp_path / f"{i}.txt").write_text("é" * i)
    df = spark.createDataFrame(rows, "i int, p string, content string").repartition(3)
    out = files.attach_files(df.withColumn("_x", F.lit(1)), F.col("p"))
    assert out.columns == ["i", "p", "_x", "content"] and not re.search("Join|FileScan", out._jdf.queryExecution().executedPlan().toString())
    assert {r.i: (r.p, r.content.decode()) for r in out.collect()} == {i: (p, "é" * i) for i, p, _ in rows}
    for path in ("/nope", None):
        with pytest.raises(Exception, match="no such file"):
            files.attach_files(spark.createDataFrame([(path,)], "p string"), F.col("p")).collect()


def test_tokens_are_counted_in_small_parts(spark):
    """By id in many parts, of which each holds little, and with no second shuffle; rows of one id add up."""
    rows = [(i % 50, f"a a b{i % 3} c{i}") for i in range(100)] + [(None, "a"), (None, "a x"), (7, None)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(3)
    dealt = similarity.by_id(df, "i", "t")
    assert dealt.rdd.getNumPartitions() == similarity.PARTS * 3
    out = similarity.count_tokens(dealt, "i", "t")
    # the deal by id, and that into three parts above
    assert len(re.findall("Exchange hashpartitioning", out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1])) == 1
    want = pd.Series([(i, t) for i, text in rows for t in plain_tokens(text)]).value_counts()
    assert {(r.i, r.token): r.n for r in out.collect()} == want.to_dict()


def test_batches_of_tokens_are_small(spark):
    """Long texts come to a task's Python a few MB at a time, whatever the session's bound was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        for bound in ("1g", "67108864"):
            spark.conf.set(key, bound)
            left = spark.createDataFrame([(i, "a b " * 50) for i in range(20)], "doc_id long, text string")
            right = spark.createDataFrame([(1, "a b"), (2, "b c")], "item_id long, text string")
            assert similarity.best_match(left, right, "doc_id", "item_id").count() == 20
            assert spark.conf.get(key) == f"{similarity.BATCH_BYTES}b"
        spark.conf.set(key, "1000b")
        similarity.pair_similarity(left, right, "doc_id", "item_id")
        assert spark.conf.get(key) == "1000b"
    finally:
        spark.conf.set(key, was)
