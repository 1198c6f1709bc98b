import string

from fitloom.llm.url_filter import canonical, judged

CASES = [
    ("https://spam-farm.org", "spam-farm.org", "", None, "block"), ("https://spam-farm.org?x=1", "spam-farm.org", "", None, "block"), ("https://casino.io#top", "casino.io", "", None, "block"), ("https://me:pw@ads.fr:8080", "me:pw@ads.fr:8080", "", None, "block"),
    ("http://%53pam.fr/%7Eme", "%53pam.fr", "/%7Eme", None, "block"), ("http://a.fr/x%2Eexe", "a.fr", "/x%2Eexe", None, "block"), ("http://h.net:80/de/", "h.net:80", "/de/", None, "allow"), ("http://a.com:80/en/1", "a.com:80", "/en/1", None, "allow"), ("http://a.com/x/../en/1", "a.com", "/x/../en/1", None, "allow"), ("http://a.com/en/../wp-login", "a.com", "/en/../wp-login", "com/en/", "block"), ("http://a.fr/b/../wp-login.php", "a.fr", "/b/../wp-login.php", None, "block"),
    ("https://fine.fr", "fine.fr", "", None, "allow"),
]


def test_globs_read_the_canonical_url_and_rules_the_url_itself(spark):
    rows = {r["page_id"]: r for r in judged(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id long, url string")).collect()}
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(rows.items())] == [c[1:] for c in CASES]


def test_unreserved_characters_are_decoded():
    plain = string.ascii_letters + string.digits + "-._~"
    for i in range(256):
        assert canonical("h", f"/x%{i:02x}") == ("h/x" + chr(i) if chr(i) in plain else f"h/x%{i:02x}")
    assert canonical("", "") == "" and canonical("[::1]:80", "") == "[::1]/"
    for path, plain in {"/a/./b": "/a/b", "/a/../b": "/b", "/../b": "/b", "/a/..": "/", "/a/.": "/a/", "/..a/.b": "/..a/.b", "/a/%2e%2E/b": "/b", "/a/b/../../c/": "/c/"}.items():
        assert canonical("h", path) == f"h{plain}", path
