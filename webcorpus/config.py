"""Job options and the fixed lists the operators work with."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: results depend on them, so they are stated as they are. ------

# Hosts links may point to (regular expressions, anchored at the start).
ALLOWED_DOMAINS = [
    r".*\.wikipedia\.org$",
    r".*\.wikimedia\.org$",
    r"docs\.python\.org$",
    r"developer\.mozilla\.org$",
    r".*\.readthedocs\.io$",
    r"stackoverflow\.com$",
    r"github\.com$",
    r"arxiv\.org$",
]

# Regular expressions that disqualify a link wherever they occur in its URL.
BLOCKED_PATTERNS = [
    r"/login", r"/register", r"/signup", r"/signin",
    r"/cart", r"/checkout", r"/admin",
    r"/api/", r"/rest/", r"/graphql",
    r"[?&]sort=", r"[?&]page=[2-9]", r"[?&]filter=",
    r"/edit", r"/delete", r"/remove",
]

# Path endings that disqualify a link.
BLOCKED_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico",
    ".mp3", ".mp4", ".avi", ".mkv", ".mov",
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".exe", ".dll", ".so", ".dylib",
]

# The 24 official languages of the European Union, ISO 639-1.
EU_LANGUAGES = [
    "bg", "cs", "da", "de", "el", "en", "es", "et", "fi", "fr", "ga", "hr",
    "hu", "it", "lt", "lv", "mt", "nl", "pl", "pt", "ro", "sk", "sl", "sv",
]

# Country-code TLD -> languages of the country, the primary one first. Generic TLDs
# (com, org, net, edu, gov, info, biz, io) say nothing and are therefore absent.
TLD_LANGUAGES = {
    "sk": ["sk"], "cz": ["cs"], "de": ["de"], "at": ["de"], "fr": ["fr"],
    "es": ["es"], "it": ["it"], "pl": ["pl"], "nl": ["nl"], "pt": ["pt"],
    "gr": ["el"], "ro": ["ro"], "bg": ["bg"], "hr": ["hr"], "hu": ["hu"],
    "lt": ["lt"], "lv": ["lv"], "ee": ["et"], "fi": ["fi"], "se": ["sv"],
    "dk": ["da"], "mt": ["mt"], "si": ["sl"],
    "be": ["nl", "fr"], "ie": ["en", "ga"], "lu": ["fr", "de"], "cy": ["el", "en"],
    "eu": ["en", "de", "fr", "es"],
    "uk": ["en"], "gb": ["en"],
}

# Hosts (and their subdomains) that are crawled whatever their URL looks like.
LANGUAGE_ALLOWLIST = [
    "wikipedia.org", "wikimedia.org", "wikidata.org", "wikisource.org",
    "wiktionary.org", "wikiquote.org", "wikinews.org",
    "europa.eu", "europarl.europa.eu", "ec.europa.eu", "consilium.europa.eu",
    "european-union.europa.eu",
    "bbc.co.uk", "bbc.com", "theguardian.com", "spiegel.de", "lemonde.fr",
    "elpais.es", "corriere.it", "reuters.com", "euronews.com",
    "archive.org", "web.archive.org",
]

# TLDs of countries outside the European Union.
NON_EU_TLDS = [
    "jp", "cn", "kr", "tw", "hk", "sg", "th", "my", "id", "ph", "vn",
    "in", "pk", "bd", "lk", "np", "mm", "kh", "la", "bn",
    "ae", "sa", "qa", "kw", "bh", "om", "ye", "jo", "lb", "sy", "iq", "il",
    "za", "eg", "ng", "ke", "tz", "ug", "gh", "ci", "sn", "ma", "tn",
    "us", "ca", "mx", "br", "ar", "cl", "co", "pe", "ve", "ec",
    "au", "nz", "pg", "fj", "nc",
    "ru", "ua", "by", "kz", "ge", "am", "az", "uz", "kg", "tj", "tm",
    "ch", "no", "is", "rs", "mk", "al", "ba", "me", "xk", "tr", "md",
]

# Value of a predicted language that marks a URL as certainly outside the EU.
SKIP = "SKIP"

# Fewest characters of a content.
MIN_CONTENT_CHARS = 50

# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class CrawlOptions:
    """Settings of a crawl job. An empty list means "use the default list"."""

    user_agent: str = "WebCorpusBot/0.1"
    # politeness
    respect_robots: bool = True
    crawl_delay: float = 1.0
    # link discovery
    extract_links: bool = True
    allowed_domains: list[str] = field(default_factory=list)
    blocked_patterns: list[str] = field(default_factory=list)
    blocked_extensions: list[str] = field(default_factory=list)
    max_depth: int = 3
    min_parent_score: int = 60
    links_per_page: int | None = None
    fixed_priority: int | None = None
    # languages of discovered links
    filter_by_language: bool = True
    allowed_languages: list[str] = field(default_factory=list)
    # answers that lead on, in one chain
    max_redirects: int = 20
    # content
    min_content_chars: int = MIN_CONTENT_CHARS
    max_content_length: int | None = None
    metadata_header: bool = False
    # site templates
    template_min_pages: int = 3
    template_share: float = 0.5

    def domains(self) -> list[str]:
        return list(self.allowed_domains or ALLOWED_DOMAINS)

    def patterns(self) -> list[str]:
        return list(self.blocked_patterns or BLOCKED_PATTERNS)

    def extensions(self) -> list[str]:
        return list(self.blocked_extensions or BLOCKED_EXTENSIONS)

    def languages(self) -> list[str]:
        return list(self.allowed_languages or EU_LANGUAGES)
