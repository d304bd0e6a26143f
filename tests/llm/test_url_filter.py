import random
import re

from cartwright.llm.url_filter import BLOCKED, MATRIX, RULES, GlobAutomaton, _pattern, judge_urls


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, place in RULES:
        name, start = place.split("/", 1)
        fits = (host == name or host.endswith("." + name)) and path.startswith("/" + start)
        if fits and (best is None or len(place) > len(best[1])):
            best = (verdict, place)
    if best:
        return host, path, best[1], best[0]
    bad = any(re.fullmatch(_pattern(g), f".{host}{path}") for g in BLOCKED)
    return host, path, None, "block" if bad else "allow"


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://COM/",
    "http://com",
    "https://WWW.Example.com/en/x?y#z",
    "https://example.com/en/",
    "https://a.example.com/en",
    "https://notexample.com/en/x",
    "https://x.net/es/1",
    "https://x.net/es",
    "https://x.org/a/x.net/es/1",
    "https://spam-farm.example.org/en/1",
    "https://x.org/spam-1/",
    "https://x.org/dir/ads/1",
    "https://x.org/set.exe",
    "https://x.org/set.exe?x",
    "http://é.org/ä/ads/",
    "x://y://z.net/fr/",
    "https://x.org/" + "a/" * 50_000 + "ads/",
]


def test_equals_plain_matching(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[6], "h"), (6, URLS[6], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = judge_urls(pages).collect()
    want = sorted((repr(i), *plain(u)) for i, u, _ in rows)
    assert sorted(((repr(r.page_id), *r[1:]) for r in found), key=repr) == sorted(want, key=repr)
    assert judge_urls(pages.where("false")).count() == 0


def test_automaton_equals_regular_expressions():
    rng = random.Random(2)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**"]) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    found = GlobAutomaton(globs).matches([t.encode() for t in texts])
    for row, text in zip(found, texts):
        for fits, glob in zip(row, globs):
            assert fits == bool(re.fullmatch(_pattern(glob), text)), (glob, text)


def test_many_rules_are_run_in_small_batches(monkeypatch):
    """10,000 globs over 300 URLs: no state matrix above the bound, same answers as one by one."""
    globs = [f"**/dir{n:05d}/*.x" for n in range(10_000)]
    automaton = GlobAutomaton(globs)
    sizes = []
    run = automaton._run
    monkeypatch.setattr(automaton, "_run", lambda t, n: sizes.append(len(t)) or run(t, n))
    texts = [f".h/a/dir{n * 33:05d}/b.x" for n in range(300)] + [".h/dir00001/c/b.x"]
    found = automaton.matches([t.encode() for t in texts])
    assert [row.nonzero()[0].tolist() for row in found] == [[n * 33] for n in range(300)] + [[]]
    assert max(sizes) * 8 * automaton.words <= MATRIX and automaton.batch() * 10_000 <= MATRIX
