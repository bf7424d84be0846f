import re

from loomlog.llm import urls as M

URLS = [
    "https://a.example.net/en/1", "http://EXAMPLE.NET/en/", "http://example.net/en", "http://notexample.net/en/1", "http://example.com/de/5?x=/en/", "http://x.example.com/de/", "http://myexample.com/de/",
    "http://foo.org/fr/1#a", "http://org/fr/1", "http://foo.org/de/1", "http://cheap-pills.example.org/en/4", "http://bestpills.example.com/en/1", "http://garden.example.com/en/2", "http://net", "http://net/", "http://a?b=/x", "http://a#b",
    "nothing", "", None, "://h/p", "x://y://z/p", "http://" + "a" * 3000 + ".com/x",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = (None, None)
    for what, rule in M.RULES:
        own, start = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, what)
    return best


def pages(spark, urls):
    html = "<p>best cheap pills garden window the house and the river example letter</p>"
    return spark.createDataFrame([(i, u, html if i % 2 else None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


def test_rows_against_brute_force(spark):
    urls = URLS + URLS[:3] + ["http://pills.example.com/en/%d" % i for i in range(20)] + ["http://garden.example.com/en/%d" % i for i in range(60)]
    got = {r.page_id: r for r in M.judged(pages(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = brute_parts(url)
        rule, said = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (said or ("block" if got[i].log_odds > 0 else "allow"))
    assert got[urls.index("http://cheap-pills.example.org/en/4")].verdict == "block" and got[urls.index("http://bestpills.example.com/en/1")].verdict == "block"
    assert got[urls.index("http://garden.example.com/en/2")].verdict == "allow"


def test_empty_tables(spark):
    assert M.judged(pages(spark, [])).count() == 0
    assert [r.verdict for r in M.judged(pages(spark, [None, ""])).collect()] == ["allow", "allow"]


def test_viterbi_takes_the_likeliest_split():
    counts = {"cheap": 50, "pills": 40, "che": 1, "ap": 2, "a": 100, "pill": 20, "s": 5}
    assert M.viterbi("cheappills", counts, 218) == ["cheap", "pills"]
    assert "".join(M.viterbi("zzqqcheapxx", counts, 218)) == "zzqqcheapxx" and M.viterbi("", counts, 218) == []


def test_word_counts(spark):
    df = pages(spark, ["x"]).selectExpr("page_id", "url", "'The the CAT <b>cat</b> c4t averyveryverylongwordindeed' AS html", "host")
    assert {r.word: r.n for r in M.word_counts(df).collect()} == {"the": 2, "cat": 2, "b": 2}


def test_joined_names_with_seeds_the_pages_do_not_hold(spark):
    urls = ["http://onlinepoker.example.com/", "http://zorblycasino.example.com/", "http://winporn.example.com/", "http://garden.example.com/", "http://roads.example.com/"]
    df = spark.createDataFrame([(i, u, "<p>" + "online win garden letter window " * 20_000 + "</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    counts = M.with_seeds(M.word_counts(df), M.SEEDS)
    labels = spark.createDataFrame([(u[7:].split(".")[0],) for u in urls], "label string")
    got = {r.label: r.words for r in M.segmented(labels, counts).collect()}
    assert got == {"onlinepoker": ["online", "poker"], "zorblycasino": ["zorbly", "casino"], "winporn": ["win", "porn"], "garden": ["garden"], "roads": ["roads"]}
    odds = {r.host.split(".")[0]: r.log_odds for r in M.judged(df).collect()}
    assert min(odds["onlinepoker"], odds["zorblycasino"], odds["winporn"]) > max(odds["garden"], odds["roads"])
