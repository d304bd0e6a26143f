import random
import re

import pytest

from cartwright.llm.automata import Automaton
from cartwright.llm.secret_scan import (
    KINDS,
    MASK,
    Formats,
    base_spans,
    find_spans,
    fit_formats,
    format_of,
    redact,
    redact_secrets,
    scan_secrets,
)
from cartwright.llm.tables import table

LETTERS = "[A-Za-z]"


def plain(text):
    """The fixed formats by unfiltered patterns, failing matches dropped afterwards."""
    text = text or ""
    word = "|".join(
        "".join(f"[{c}{c.upper()}]" for c in w) if w != "key" else ""
        for w in ("password", "passwd", "secret", "token")
    )
    word += "|[aA][pP][iI]_?[kK][eE][yY]"
    assign = re.compile(rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_equals_plain_patterns(spark, sf):
    rng = random.Random(8)
    texts = [r.text for r in table(spark, sf.replace("0.001", "0.01"), "documents").collect()]
    bits = ["password", "Token", "apı_key", "API_KEY", "apikey", "ſecret", "SECRET", " ", "=", ":", '"']
    bits += ["'", "abc123", "x", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "ab", "\n", "é", "-", "=="]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    texts += [None, ""]
    for text in texts:
        assert base_spans(text) == plain(text), text


@pytest.fixture(scope="module")
def formats():
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 40)))) for _ in range(300)]
    words = ["".join(rng.choice(["th", "er", "ing", "on", "re"]) for _ in range(7)) + rng.choice("123") for _ in range(300)]
    cards = ["4" + "".join(rng.choice("0123456789") for _ in range(15)) for _ in range(300)]
    kinds = [Automaton(map(format_of, hexes)).merge()]
    return Formats(kinds, [Automaton(map(format_of, some)).merge() for some in (words, cards)])


def test_learned_formats_add_spans(formats):
    secret = "b7b8a0c022e6cc4d66"
    text = f"the key {secret} and card 4410694465293914 and theringthonreerthing1 here"
    base, every = find_spans(text, formats)
    assert base == []
    assert [(text[a:b], kind) for a, b, kind in every] == [(secret, "format")]


def test_every_run_is_scored(formats):
    """Digit-free runs and the rest of a run beside a base span; words, numbers and short runs stay."""
    hexes, glued = "decafbadfacedeadbeefbabe", "decafbadfacedeadbeefbab+"
    text = f"say {hexes[:22]}x and {'fade' * 5} or token=abcdef1é{'c0ffee12' * 2} {glued}"
    base, every = find_spans(text, formats)
    added = [s for s in every if s not in base]
    runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_-]{6,}={0,2}", text)]
    free = [r for r in runs if all(r[1] <= a or r[0] >= b for a, b, _ in base)]
    want = [(*r, "format") for r in free if formats.odds(format_of(text[slice(*r)])) >= 13.8]
    assert added == want and "c0ffee12c0ffee12" in {text[a:b] for a, b, _ in added}
    for run in ("decade", "facade", "abc123", "QQzzee", "extraordinary", "4410694465293914"):
        assert not formats.is_secret(run), run


def test_remembered_verdicts_equal_plain_scores(formats):
    """Automata stepped symbol by symbol in plain numbers, over runs of all formats."""
    rng = random.Random(12)

    def chance(automaton, shape):
        at, total = 0, 1.0
        for symbol in [*shape, None]:
            if at is None:
                total *= 1e-4
                continue
            hits = automaton.ended[at] if symbol is None else automaton.taken[at].get(symbol, 0)
            total *= hits / automaton.passed[at] if hits else 1e-4
            at = None if symbol is None else automaton.steps[at].get(symbol)
        return total

    for _ in range(2000):
        run = "".join(rng.choice("0a9fzQ-") for _ in range(rng.randint(6, 24)))
        shape = format_of(run)
        other = max([10.0 ** -(len(run) + 1), *(chance(o, shape) for o in formats.ordinary)])
        ratio = max(chance(k, shape) for k in formats.kinds) / other
        if abs(ratio / 985_000 - 1) > 0.1:
            assert formats.is_secret(run) == (ratio > 985_000), run


def test_merged_automaton_is_smaller_and_a_distribution():
    rng = random.Random(2)
    samples = ["ab" * (1 + int(rng.expovariate(0.5))) for _ in range(500)]
    tree, merged = Automaton(samples), Automaton(samples).merge()

    def reached(automaton):
        seen, waiting = {0}, [0]
        while waiting:
            for follow in automaton.steps[waiting.pop()].values():
                if follow not in seen:
                    seen.add(follow)
                    waiting.append(follow)
        return seen

    assert len(reached(merged)) <= 4 < len(reached(tree))
    for state in reached(merged):
        assert merged.passed[state] == merged.ended[state] + sum(merged.taken[state].values())
    assert merged.log_likelihood("abab") > merged.log_likelihood("abba")


def test_redaction_masks_every_span():
    text = 'x password=abc123456789012345678901234 y token = "abcdef" z'
    spans = base_spans(text)
    assert redact(text, spans) == f'x {MASK} y {MASK}" z'
    assert redact("", []) == "" and redact(None, []) is None


def test_odd_documents(make_docs, odd_docs, no_docs):
    learned = fit_formats(odd_docs)
    rows = scan_secrets(odd_docs, learned).collect()
    assert len(rows) == odd_docs.count() and all(not r.spans for r in rows)
    assert redact_secrets(odd_docs, learned).columns == odd_docs.columns
    same = sorted(map(repr, redact_secrets(odd_docs, learned).collect()))
    assert same == sorted(map(repr, odd_docs.collect()))
    assert scan_secrets(no_docs, fit_formats(no_docs)).count() == 0
    one = make_docs([(1, 'é token = "abcdef1"', "en"), (1, 'é token = "abcdef1"', "en")])
    assert [[tuple(s) for s in r.base] for r in scan_secrets(one, learned).collect()] == [[("assign", 2, 18)]] * 2
    assert {r.text for r in redact_secrets(one, learned).collect()} == {f'é {MASK}"'}


def test_a_kind_is_learned_however_rare_it_is(spark):
    """Fifteen documents of 40,000 hold access keys; a key with a lower-case start is then added."""
    rng = random.Random(4)

    def key():
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(24))

    docs = spark.range(40_000).selectExpr(
        "id AS doc_id",
        "concat('order ', lower(hex(id)), '-plain-run-', id, '-of-words here') AS text",
    )
    keys = spark.createDataFrame([(50_000 + i, f"use AKIA{key()} now") for i in range(15)], docs.schema)
    learned = fit_formats(docs.union(keys))
    assert len(learned.kinds) == 1
    assert learned.is_secret("AKI1" + key())
    assert not learned.is_secret("ab12-plain-run-77-of-words")


def test_learned_values_do_not_depend_on_partitions(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    one, many = fit_formats(docs.coalesce(1)), fit_formats(docs.repartition(7))
    runs = ["b7b8a0c022e6cc4d66", "hunter2hunter2", "plain-words-and-1", "A1B2C3D4E5F6G7H8"]
    assert len(one.kinds) == len(many.kinds) > 0
    for run in map(format_of, runs):
        assert [k.log_likelihood(run) for k in (*one.kinds, *one.ordinary)] == [
            k.log_likelihood(run) for k in (*many.kinds, *many.ordinary)
        ]
