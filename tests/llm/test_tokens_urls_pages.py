import random

import pytest
from pyspark.sql import functions as F

from conftest_llm import odd_rows, prose, with_clashes
from veriform.llm import html_blocks, token_count, url_cascade
from veriform.llm.queries import RULES


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def scores():
    import public_tokenizers

    return token_count.load_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))


ODD = ["", " ", "  a", "a  ", "\n\n", "▁▁ x▁y", "<s>text</s><unk>", "日本語のテキスト", "a" * 500, " " * 300, "\t\tdef f(x):\n    return x ** 2", "naïve 😀 ​ zero", "don't stop...!!!", "x\x00y", "ⅷ ﬁ Å"]


def test_counts_match_the_library(model, scores):
    rng = random.Random(0)
    machine = token_count.Transducer(scores)
    pool = "abcdefghijklmnopqrstuvwxyz     ,.'-0123456789éüßñ日本\n\tABC▁"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(400)] + [prose(rng, 300)]
    for t in texts:
        n = machine.count(token_count.MARK + t.replace(" ", token_count.MARK)) if t else 0
        assert n == len(model.encode(t)), t


def test_chunk_maps_compose(model, scores):
    rng = random.Random(1)
    machine = token_count.Transducer(scores)
    for t in [x for x in ODD if x] + [prose(rng, 60), "   " + prose(rng, 20) + "     x"]:
        for size in (1, 2, 3, 7, 40):
            marked = token_count.MARK + t.replace(" ", token_count.MARK)
            maps = [token_count.chunk_map(marked[i : i + size], machine) for i in range(0, len(marked), size)]
            assert token_count._tree(maps, machine) == len(model.encode(t)), (t, size)


def test_forgetting_changes_nothing(model, scores, monkeypatch):
    monkeypatch.setattr(token_count, "KEEP", 20)
    machine = token_count.Transducer(scores)
    text = prose(random.Random(2), 400)
    assert machine.count(token_count.MARK + text.replace(" ", token_count.MARK)) == len(model.encode(text))


def test_long_texts_are_cut_and_rows_kept(make_docs, scores, model, rng):
    rows = [*odd_rows(rng), (40, prose(rng, 500)), (40, prose(rng, 500)), (41, "same " * 300), (41, "same " * 300)]
    got = token_count.token_counts(with_clashes(make_docs(rows)), scores, chunk=1000)
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    assert sorted((str(r["id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert token_count.token_counts(make_docs([]), scores).count() == 0


URLS = [
    "http://a.example.net/en/1", "http://A.Example.NET/x?y", "http://example.net", "https://example.com/de/", "https://bad.example.com/de", "ftp://x.org/fr/1#z", "http://org/fr/",
    "http://notexample.net.evil/en/", "//x.org/fr/", "", None, "http://", "http://casino-win.example.org/fr/1", "http://m.casino-win.example.org/en/1", "http://casino-winner.org/",
    "http://x.org?q=://y.net/", "http://free-bets.com#top", "http://free-bets.com#top", "http://x.net:80/", "a://b://c.net/",
]


def judge(url):
    rest = (url or "").partition("://")[2]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    rule = None
    for r in sorted(RULES, key=lambda r: -len(r.pattern)):
        h, p = r.pattern.split("/", 1)
        if rule is None and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            rule = r
    return host, path, rule.pattern if rule else None, rule.verdict if rule else None


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")


def test_rules_and_listed_hosts(spark):
    pages = with_clashes(pages_of(spark, URLS)).withColumns({"host": F.lit("h"), "rule": F.lit("r"), "listed": F.lit(True), "at": F.lit(1)})
    names = ("casino-win", "free-bets")
    listed = spark.createDataFrame([("casino-win.example.org",), ("free-bets.com",), ("nowhere.test",), (None,)], "host string")
    by_name = lambda h: F.arrays_overlap(F.split(h, r"\."), F.array(*[F.lit(n) for n in names]))
    for on_list in (listed, by_name):
        for at_once in (url_cascade.KEYS_AT_ONCE, 1):
            got = {r["id"]: r for r in url_cascade.judge_urls(pages, RULES, on_list, keys_at_once=at_once).collect()}
            assert len(got) == len(URLS)
            for i, u in enumerate(URLS):
                host, path, rule, verdict = judge(u)
                bad = any(n in host.split(".") for n in names)
                assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or ("block" if bad else "allow")), u


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(6)
    urls = [f"http://h{i}.example.test/p" for i in range(4000)]
    listed = set(rng.sample(range(4000), 700))
    table = spark.createDataFrame([(f"h{i}.example.test",) for i in listed], "host string")
    got = url_cascade.judge_urls(pages_of(spark, urls), [], table).collect()
    assert {r["id"] for r in got if r["verdict"] == "block"} == listed and len(got) == 4000
    assert all(r["rule"] is None for r in got)


def test_empty_pages_and_lists(spark):
    none = spark.createDataFrame([], "host string")
    assert url_cascade.judge_urls(pages_of(spark, []), RULES, none).count() == 0
    assert {r["verdict"] for r in url_cascade.judge_urls(pages_of(spark, ["http://x.com/", None]), RULES, none).collect()} == {"allow"}


ARTICLE = "<p>It was the best of times, and it was the worst of times for all of them.</p>"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just words", ""), ("<html><body></body></html>", ""),
    (f"<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article><h1>Head</h1>{ARTICLE}</article><footer>&copy; us</footer></body></html>",
     "Head It was the best of times, and it was the worst of times for all of them."),
    ("<article><p>a &amp; b\n\t c<br>d</p><script>var x = '</p>';</script><style>p{}</style><p>e&#8217;f &eacute;<b>g</b>h</p></article>", "a & b c d e’f égh"),
    ("<article><p><b>open<br><p>next<p>last</article><div class='sidebar'>side</div>", "open next last"),
    ("<main><article><p>text</p><div class='ad'>buy</div><aside>x</aside><form>f</form><section id='comments'><p>me too</p></section></article></main>", "text"),
    ("<ARTICLE><P>Upper</P></ARTICLE><!-- <article>no</article> --><div class=cookie-notice>We use cookies</div>", "Upper"),
    ("<body class='has-sidebar'><div class='page with-sidebar'><article><p>kept</p></article></div></body>", "kept"),
    ("<article><p>1 < 2 and 3 > 2</p><p>unclosed <a href='x'>link", "1 < 2 and 3 > 2 unclosed link"),
])
def test_main_text(page, text):
    assert html_blocks.main_text(page or "") == text


def test_undecided_blocks_follow_their_neighbours():
    long_ = "It is one of the things that you will see when you are in the town and there is more to it than that, as they say, for it was there and they were not."
    page = f"<div>Home</div><div><a href='a'>One</a> <a href='b'>Two</a></div><h2>A head</h2><p>{long_}</p><p>Short one.</p><p>{long_}</p><div><a href='x'>All links here</a></div><div>Imprint</div>"
    assert html_blocks.main_text(page) == f"A head {long_} Short one. {long_}"


@pytest.mark.parametrize("attributes", [
    'class="content with-sidebar"', 'class="post share-enabled"', 'style="overflow:hidden"', 'class="overflow-hidden"', "id=content-with-sidebar",
    'data-state="hidden"', 'class="layout-sidebar"', "class=widget",
])
def test_names_of_wrappers_keep_the_text(attributes):
    text = "It is one of the things that you will see when you are in the town and there is more to it than that, as they say. " * 3
    for page in (f"<div {attributes}><p>{text}</p></div>", f"<article><div {attributes}><p>{text}</p></div></article>"):
        assert html_blocks.main_text(page) == text.strip()


@pytest.mark.parametrize("attributes", ['class="sidebar"', 'class="sidebar-left x"', 'id="site-footer"', "role=navigation", "hidden", 'style="color:red; visibility:hidden"', 'style="display:none"', 'class="comments-list"'])
def test_names_beside_the_article_still_count(attributes):
    text = "It is one of the things that you will see when you are in the town and there is more to it than that, as they say. " * 3
    beside = "This is what they have to say about it, and there is not more in it for you than that, as you will see."
    assert html_blocks.main_text(f"<div><p>{text}</p></div><div {attributes}><p>{beside}</p></div>") == text.strip()


def test_languages_without_listed_stop_words():
    text = "Kissa juoksi metsän halki kohti järveä, jonka rannalla vanha kalastaja korjasi verkkojaan hiljaisena aamuna. " * 3
    assert html_blocks.main_text(f"<div><a href='a'>Etusivu</a></div><p>{text}</p><div><a href='b'>Yhteys</a></div>") == text.strip()


def test_pages_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", f"<article>{ARTICLE * 3000}</article>"), (3, "v", "<article><p>x</p></article>"), (3, "v", "<article><p>x</p></article>")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.lit(1))
    got = html_blocks.extract_main_text(pages)
    assert sorted((r["id"], r["url"] or "", len(r["text"])) for r in got.collect()) == [(1, "u", 0), (2, "", 0), (3, "v", 1), (3, "v", 1), (3, "v", 3000 * 73 - 1)]
    assert html_blocks.extract_main_text(pages.limit(0)).count() == 0
