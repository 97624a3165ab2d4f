"""URL language prediction: rule by rule, then the order of the rules."""

import pytest
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions, EU_LANGUAGES
from webcorpus.functions import language
from webcorpus.operators import language as languages

URLS = {
    # country-code TLDs
    "https://example.sk/page": "sk", "https://example.de/page": "de", "https://example.at/page": "de",
    "https://example.cz/page": "cs", "https://example.fr/page": "fr", "https://example.es/page": "es",
    "https://example.it/page": "it", "https://example.pl/page": "pl", "https://example.nl/page": "nl",
    "https://example.gr/page": "el", "https://example.be/page": "nl", "https://example.eu/page": "en",
    # paths
    "https://example.com/en/page": "en", "https://example.com/de/article": "de",
    "https://example.com/sk/news": "sk", "https://example.com/fr/page": "fr",
    "https://example.com/en-us/page": "en", "https://example.com/de/": "de",
    "https://example.com/about": None, "https://example.com/EN/": None,
    "https://example.com/en;v=1": "en", "https://example.com/en;v/x": None,
    # subdomains
    "https://en.example.com/page": "en", "https://de.example.org/page": "de",
    "https://fr.example.org/page": "fr", "https://sk.news.com/article": "sk",
    "https://www.example.com/page": None, "https://zz.example.com/": "zz",
    # query parameters
    "https://example.com/page?lang=en": "en", "https://example.com/page?language=de": "de",
    "https://example.com/page?locale=sk": "sk", "https://example.com/page?id=123&lang=fr&sort=date": "fr",
    "https://example.com/page?lang=english": "en", "https://example.com/page#?lang=en": None,
    "https://example.com/page?xlang=en": None,
    # always crawled
    "https://wikipedia.org/wiki/Test": None, "https://en.wikipedia.org/wiki/Test": None,
    "https://europa.eu/page": None, "https://bbc.co.uk/news": None,
    "https://theguardian.com/article": None, "https://notspiegel.de/": "de",
    # outside the EU
    "https://example.jp/page": "SKIP", "https://example.cn/page": "SKIP", "https://example.kr/page": "SKIP",
    "https://example.ru/page": "SKIP", "https://example.us/page": "SKIP", "https://example.br/page": "SKIP",
    "https://en.example.jp/": "en", "https://example.jp/de/": "de",
    # unknown
    "https://example.com/page": None, "https://example.org/page": None, "https://example.net/page": None,
    "https://example.io/page": None, "not-a-url": None, "": None, "http://[::1/en/": None,
    # edge cases
    "https://example.sk:8080/page": "sk", "https://example.de/page#section": "de",
    "https://EXAMPLE.SK/PAGE": "sk", "http://example.de/page": "de",
    # order of the rules
    "https://wikipedia.org/test": None, "https://example.com/de/page": "de",
    "https://fr.example.com/de/page": "fr",
}


@pytest.fixture(scope="module")
def predicted(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    return {r.url: r.lang for r in df.select("url", language.predict_language(F.col("url")).alias("lang")).collect()}


@pytest.mark.parametrize("url", list(URLS))
def test_prediction(predicted, url):
    assert predicted[url] == URLS[url]


def test_null_url_is_unknown(spark):
    df = spark.createDataFrame([(None,)], "url string")
    assert df.select(language.predict_language(F.col("url")).alias("lang")).first().lang is None


def test_fixed_lists_are_complete():
    from webcorpus import config
    assert len(EU_LANGUAGES) == 24 == len(set(EU_LANGUAGES))
    assert len(config.TLD_LANGUAGES) == 30
    assert len(config.LANGUAGE_ALLOWLIST) == 23
    assert len(config.NON_EU_TLDS) == len(set(config.NON_EU_TLDS)) == 80


def test_filter(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    tagged = languages.with_language(df)
    kept = {r.url for r in languages.filter_language(tagged, CrawlOptions()).collect()}
    assert kept == {u for u, lang in URLS.items() if lang is None or lang in EU_LANGUAGES}
    some = languages.filter_language(tagged, CrawlOptions(allowed_languages=["sk", "SKIP"]))
    assert {r.url for r in some.collect()} == {u for u, lang in URLS.items() if lang in (None, "sk")}
    off = languages.filter_language(tagged, CrawlOptions(filter_by_language=False))
    assert off.count() == len(URLS)
