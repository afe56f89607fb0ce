import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duskwatch.llm import html_wrapper, language_id
from duskwatch.llm.dom import blocks, parse
from duskwatch.llm.html_wrapper import Node, _align, _score, extract, fold, merge, wrapper_of

# Syllables that a made-up language puts its words together from.
SYLLABLES = {"aa": "ba lo mi ra su te", "bb": "ñi ko zé ul or va", "cc": "жа по ти ки ре до"}


def text_in(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, text_in(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 60)), lang, "src", 0) for i in range(400)]
    rows += [(1000, None, "aa", "src", 0), (1001, "", None, "src", 0), (1002, "123 !! $$ ½²", "bb", "src", 0)]
    rows += [(None, rows[0][1], "cc", None, None), (1003, rows[1][1] + " " * 9 + rows[1][1] * 3000, None, "s", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score int")


@pytest.fixture(scope="module")
def model(corpus):
    train = corpus.where(~language_id.held_out(F.col("doc_id")) & (F.col("doc_id") < 1000))
    return language_id.fit(train.select("doc_id", "text", "lang"))


def test_held_out_accuracy(corpus, model):
    told = language_id.identify(corpus, model).where("doc_id < 1000").where(language_id.held_out(F.col("doc_id"))).collect()
    assert len(told) > 60
    assert np.mean([r["lang_pred"] == r["lang"] for r in told]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in told)


def test_every_row_once_with_its_columns(corpus, model):
    told = {r["doc_id"]: r for r in language_id.identify(corpus, model).collect()}
    assert len(told) == corpus.count()
    for i in (1000, 1001, 1002):
        assert (told[i]["lang_pred"], told[i]["score"]) == ("und", 0.0)
    assert told[1003]["lang_pred"] == told[1]["lang_pred"]
    assert told[1003]["source"] == "s"


def test_columns_the_model_must_not_see(corpus, model):
    other = corpus.withColumns({"lang": F.lit("aa"), "source": F.lit("x")}).select("text", "lang", "source", "doc_id")
    a = language_id.identify(corpus, model).groupBy("text", "lang_pred", "score").count().collect()
    b = language_id.identify(other, model).groupBy("text", "lang_pred", "score").count().collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_backoff_from_words_to_shorter_grams():
    logs = np.array([[-1, -2], [-3, -4], [-5, -6], [-7, -8]], float)
    m = language_id.LanguageModel(("a", "b"), {"known": 0}, {"ab": 1, "bc": 2, "z": 3}, logs)
    assert m.word_scores("known").tolist() == [-1, -2]
    assert m.word_scores("abc").tolist() == [-4, -5]
    assert m.word_scores("xz").tolist() == [-7, -8]
    assert m.word_scores("qqq").tolist() == [0, 0]


def test_nothing_to_learn_from(corpus):
    empty = language_id.fit(corpus.limit(0).select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(corpus, empty).collect()} == {"und"}
    assert language_id.identify(corpus.limit(0), empty).count() == 0


def test_batches_do_not_matter(model):
    rng = random.Random(1)
    texts = [text_in(rng, "bb", n) for n in (1, 2, 50)] + ["", "7"]
    memory = language_id._Memory(model)
    together = language_id.score_texts(pa.array(texts), memory)
    alone = [language_id.score_texts(pa.array([t]), memory) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone])


def test_small_languages_keep_rows_words_and_grams(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, text_in(rng, "aa", 30), "aa") for i in range(3000)] + [(i, text_in(rng, "cc", 30), "cc") for i in range(3000, 3012)]
    rows += [(None, text_in(rng, "aa", 30), "aa") for _ in range(2000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(language_id, "MAX_WORDS", 20)
    monkeypatch.setattr(language_id, "MAX_GRAMS", 20)
    small = language_id.fit(table, train_rows=50)
    assert small.languages == ("aa", "cc")
    assert any("ж" in w for w in small.words) and any("жа" in g for g in small.grams)
    told = language_id.identify(table.where("lang = 'cc'"), small).collect()
    assert {r["lang_pred"] for r in told} == {"cc"}


# Pages


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a&amp;amp; <b>b</b>c&nbsp;\n d<br>e<p>f", ["a&amp; bc d e", "f"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<div>a<div class='AdBox'>ad</div>b</div>", ["a", "b"]),
        ("<div>a<div id=cookie-notice>n</div>b</div>", ["a", "b"]),
        ("<p>a<!-- <p>no</p> --><script>var t='</p>';</script>b", ["ab"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("a < b & c", ["a < b & c"]),
        ("<p title='>'>t</b></i></p></div>u", ["t", "u"]),
        ("<![CDATA[x<y]]><?php no ?>", ["x<y"]),
        ("<h1 class=header>kept</h1><section class='comment-list'>no</section><div role=navigation>no</div>", ["kept"]),
        ("<p><b>one<br><p>two</p>", ["one", "two"]),
        ("<style>p{}</style><noscript>no</noscript><form>no<input></form>x", ["x"]),
        ("", []), ("<", ["<"]), ("<p", ["<p"]), ("<script>never ends", []),
    ],
)
def test_blocks(page, want):
    assert blocks(parse(page)) == want


def tree(key, *children, text=()):
    return Node(key, 1, False, list(text), list(children))


def test_simple_tree_matching():
    a = tree("r", tree("x", tree("y")), tree("z"))
    b = tree("r", tree("q"), tree("x", tree("y"), tree("y")), tree("w"), tree("z"))
    assert _score(a, b) == 4
    assert _align(a.children, b.children)[1] == [(0, 1), (1, 3)]
    assert [c.key for c in merge(a, b).children] == ["q", "x", "w", "z"]
    assert _score(tree("r"), tree("s")) == 0


def page(i, body, host="a.com"):
    return (i, f"http://{host}/{i}", body)


def site(i, words, boxed=False):
    """A page without telling names: constant boxes around a changing text."""
    text = f"<div class=c1><h2>Title {i}</h2><p>{words}</p></div>"
    inner = f"<article>{text}</article>" if boxed else text
    return f"<html><body><div class=c0><p>Welcome to our site</p></div>{inner}<div class=c2>All rights of all</div></body></html>"


PAGES = "page_id bigint, url string, html string, text string, host string"


def run(spark, rows):
    table = spark.createDataFrame([(*r, "t", "h") for r in rows], PAGES)
    return {r["page_id"]: r for r in html_wrapper.extract_main_text(table).collect()}


def test_constant_nodes_are_template(spark):
    rows = [page(i, site(i, f"words of page {i}")) for i in range(12)]
    rows += [page(50, site(50, "alone"), "b.org"), (60, None, None), (61, "odd", ""), (62, None, "<p>x</p>")]
    got = run(spark, rows)
    assert got[3]["text"] == "Title 3\nwords of page 3" and got[3]["n_chars"] == len(got[3]["text"])
    # one page of a host tells nothing about its template
    assert got[50]["text"] == "Welcome to our site\nTitle 50\nalone\nAll rights of all"
    assert (got[60]["text"], got[60]["n_chars"], got[61]["text"], got[62]["text"]) == ("", 0, "", "x")


def test_copies_of_one_page_are_not_template(spark):
    got = run(spark, [page(i, site(1, "the very same", boxed=True)) for i in range(20)])
    assert {r["text"] for r in got.values()} == {"Title 1\nthe very same"}


def test_repeated_paragraphs_are_content(spark):
    rows = [page(i, f"<article><p>first {i}</p><p>Released as is.</p><p>last {i * i}</p></article>") for i in range(12)]
    assert run(spark, rows)[7]["text"] == "first 7\nReleased as is.\nlast 49"


def test_article_without_what_surrounds_it(spark):
    body = (
        "<head><title>t</title></head><header>h</header><nav><a>n</a></nav><div class='sidebar'>s</div>"
        "<main><article><h1>A&#233;</h1><p>one <a href=x>two</a></p><aside>x</aside><div class=comments><p>c</p></div></article></main>"
        "<footer>f</footer>"
    )
    long = "<article>" + "<p>word " * 30_000 + "</article>"
    got = run(spark, [page(1, body), page(1, body), page(2, long), page(3, "<div>" * 3000 + "deep")])
    assert got[1]["text"] == "Aé\none two"
    assert got[2]["n_chars"] == 30_000 * 5 - 1 and got[3]["text"] == "deep"
    assert html_wrapper.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    "around", ["<div class='content has-sidebar'>{}</div>", "<div id='no-sidebar'>{}</div>", "<form><div>{}</div></form>",
               "<section class='discussion'><form>{}</form></section>"],
)
def test_articles_in_elements_with_telling_words(around):
    body = around.format("<article><h1>T</h1><p>text</p><div class=ad>a</div></article><div class=share>s</div>")
    assert extract(f"<body><nav>n</nav>{body}</body>", None) == "T\ntext"
    assert extract(f"<body><main>{body}</main></body>", None) == "T\ntext"
    # teasers and comments are no articles of the page
    assert extract(f"<body><article>{'own ' * 20}</article>{body}</body>", None) == ("own " * 20).strip()
    assert extract(f"<body><p>own</p><div class=comments>{body}</div></body>", None) == "own"


def test_long_varying_text_stays_whatever_its_class(spark):
    long = lambda i, k: " ".join(f"{k}{i}x{j}" for j in range(60))
    same = " ".join(f"same{j}" for j in range(60))
    rows = [
        page(i, f"<body><article><p>{long(i, 'p')}</p><section class=discussion><p>{long(i, 'd')}</p></section><div class=ad>buy {i}</div>"
                f"<div class=related><a href=x>{long(i, 'r')}</a></div><div class=notice>{same}</div><div class=comments>{long(i, 'c')}</div></article>")
        for i in range(9)
    ]
    rows += [page(i, f"<body><form><div>Welcome</div><p>{long(i, 'f')}</p></form>", "forms.com") for i in range(20, 29)]
    got = run(spark, rows)
    assert got[4]["text"] == f"{long(4, 'p')}\n{long(4, 'd')}"
    assert got[24]["text"] == long(24, "f")


@pytest.mark.parametrize("n", [4, 5, 30])
@pytest.mark.parametrize("box", ["article", "div"])
def test_near_copies_of_one_page_keep_their_title(spark, n, box):
    html = "<html><head><title>One</title></head><body><{0}><h1>One</h1><p>text {1}</p><h2>End</h2></{0}></body></html>"
    got = run(spark, [page(i, html.format(box, i)) for i in range(n)])
    assert {r["text"] for r in got.values()} == {f"One\ntext {i}\nEnd" for i in range(n)}


@pytest.mark.parametrize("head", ["header", "header class='entry-header'", "div class=article-header"])
def test_the_header_of_an_article_is_its_own(head):
    tag = head.split()[0]
    body = f"<article><{head}><h1>The title</h1><p>Lead.</p><nav>n</nav></{tag}><p>Body.</p><footer>f</footer></article>"
    assert extract(f"<body><header><h1>Site</h1></header><div class=header>s</div>{body}</body>", None) == "The title\nLead.\nBody."


def test_headings_inside_articles_and_rare_slots_stay(spark):
    rows = [page(i, f"<body><div>Welcome</div><article><h1>T{i}</h1><h2>Summary</h2><p>text {i}</p></article>") for i in range(9)]
    assert run(spark, rows)[2]["text"] == "T2\nSummary\ntext 2"
    tail = lambda i: "<div class=tail>Tail</div>" if i < 5 else ""
    rows = [page(i, f"<body><div class=top>Welcome</div><p>text {i}</p>{tail(i)}") for i in range(600)]
    got = run(spark, rows)
    assert got[3]["text"] == "text 3\nTail" and got[9]["text"] == "text 9"


def test_merging_in_any_order_is_the_same():
    rng = random.Random(3)
    own = [fold(wrapper_of(parse(site(i, f"w {i}", boxed=i % 2 == 0)))[0]) for i in range(9)]
    packed = set()
    for _ in range(5):
        rng.shuffle(own)
        packed.add(str(sorted(map(str, html_wrapper.merge_all(own).pack()[4]))))
    assert extract(site(3, "w 3"), html_wrapper.merge_all(own)) == "Title 3\nw 3"


# Pipeline


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}" for _ in range(n))
    base, item = text(60), text(20)
    rows = [(i, text(50), "en", "s", 1, "x") for i in range(20)]
    rows += [(100, base, "en", "s", 1, "x"), (101, base + " more", "en", "s", 1, "x"), (99, base, None, None, None, None)]
    rows += [(200, f"{text(30)} {item} {text(30)}", "en", "s", 1, "x"), (300, None, "en", "s", 1, "x"), (301, "12 ..", "en", "s", 1, "x")]
    rows += [rows[0]]
    spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    want = [{300, 301}, {100, 101}, {200}]
    for (_, stage), gone in zip(corpus_pipeline.STAGES, want):
        before = left
        left = stage(spark, before, str(tmp_path))
        assert left.columns == docs.columns
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        assert ids(before) - ids(left) == gone
    assert left.count() == 21
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == {*range(20), 99}


def test_stages_judge_rows_with_null_and_repeated_ids_by_their_texts(spark, tmp_path):
    rng = random.Random(7)
    text = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}" for _ in range(n))
    a, b, c, d, item = text(60), text(60), text(60), text(60), text(20)
    held = f"{text(30)} {item}"
    rows = [
        (None, a, "no id, copy of 1"), (1, a, "stays"), (None, b, "no id, alone"), (None, b, "no id, again"),
        (5, c, "repeated id"), (5, d, "repeated id, other text"), (6, d + " more", "like 5"), (5, c, "the same row again"),
        (None, held, "no id, contaminated"), (1, held, "repeated id, contaminated"), (8, "", "empty"), (8, "", "empty"),
        (None, None, "null"), (None, None, "null"),
    ]
    spark.createDataFrame([(1, item), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", n, n) for i, t, n in rows], "doc_id bigint, text string, lang string, key string, `row` string")
    left = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    of = lambda *kept: sorted((str(i), t or "") for i, t in kept)
    blank = [(8, ""), (8, ""), (None, ""), (None, "")]

    got = corpus_pipeline.keep_one_of_similar(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert left(got) == of((1, a), (None, b), (5, c), (5, d), (1, held), *blank)
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert left(got) == of(*[(i, t) for i, t, _ in rows if t != held])
    got = corpus_pipeline.keep_known_language(spark, docs, str(tmp_path))
    assert left(got) == of(*[(i, t) for i, t, _ in rows if t])
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
    assert packed.select("doc_id", "start").count() == len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
