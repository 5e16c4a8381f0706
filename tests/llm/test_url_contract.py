"""The production rules of the URL filter next to the list in its contract."""

from voxlake.llm import queries, urls

CONTRACT = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}


def test_places_have_the_verdicts_of_the_contract(spark):
    assert {r.place: r.verdict for r in queries.URL_RULES if r.place} == CONTRACT
    hosts = ("a.example.org", "EXAMPLE.org", "b.org", "c.com")
    paths = ("/en/1", "/en/12?x", "/en/2", "/es/", "/fr/", "/de/a")
    rows = [(k, f"x://{h}{p}") for k, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING")
    for r in urls.judge(pages, queries.URL_RULES).collect():
        fits = [
            place for place in CONTRACT
            if f".{r.host}".endswith("." + place.partition("/")[0])
            and r.path.startswith("/" + place.partition("/")[2])
        ]
        rule = max(fits, key=len, default=None)
        assert (r.rule, r.verdict) == (rule, CONTRACT.get(rule, "allow")), r.url
