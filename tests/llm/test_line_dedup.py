import random
import re

import pytest
from pyspark.sql import functions as F

from cartwright.llm.line_dedup import LEAST_WORDS, dedup_lines
from cartwright.llm.tables import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def chunks_of(windows, least_words):
    """Runs of windows whose first occurrences run along, as (doc, kind, at, after, first, last)."""
    runs, by_key = [], {}
    for w in sorted(windows, key=lambda w: (w["doc"], w["kind"], w["kept"][0], w["kept"][1] - w["at"], w["at"])):
        key = (w["doc"], w["kind"], w["kept"][0], w["kept"][1] - w["at"])
        last = by_key.get(key)
        if last and last["after"] == w["at"] + w["kind"] - 1:
            last.update(after=w["at"] + w["kind"], last=w["last"], words=last["words"] + w["new"])
        else:
            by_key[key] = last = dict(w, after=w["at"] + w["kind"])
            runs.append(last)
    return [r for r in runs if r["words"] >= least_words]


def plain(rows, least_words=LEAST_WORDS):
    """The documented rule by plain loops over the lines themselves; ids are distinct."""
    windows, first = [], {}
    docs = sorted(((1 << 63 if d is None else d), t) for d, t in rows if t)
    for doc, text in docs:
        lines = text.split("\n")
        filled = [(i, line, len(WORD.findall(line))) for i, line in enumerate(lines)]
        filled = [f for f in filled if f[2]]
        for at, (i, line, words) in enumerate(filled):
            if at + 1 < len(filled):
                j, after, more = filled[at + 1]
                windows.append(dict(doc=doc, kind=2, at=at, first=i, last=j + 1, body=(line, after), words=words + more, new=more))
            if words > 50:
                windows.append(dict(doc=doc, kind=1, at=at, first=i, last=i + 1, body=(line,), words=words, new=words))
    for w in windows:
        first.setdefault(w["body"], (w["doc"], w["at"]))
    again = []
    for w in windows:
        w["kept"] = first[w["body"]]
        if w["doc"] != w["kept"][0] or w["at"] >= w["kept"][1] + w["kind"]:
            again.append(w)
    lost = {(c["doc"], at) for c in chunks_of(again, least_words) for at in range(c["at"], c["after"])}
    broken = {
        w["body"] for w in again
        if any((w["kept"][0], w["kept"][1] + k) in lost for k in range(w["kind"]))
    }
    gone = {}
    for c in chunks_of([w for w in again if w["body"] not in broken], least_words):
        gone.setdefault(c["doc"], set()).update(range(c["first"], c["last"]))
    out = []
    for doc, text in rows:
        lost_here = gone.get(1 << 63 if doc is None else doc, set()) if text else set()
        left = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in lost_here)
        out.append((repr(doc), left if lost_here else text, len(lost_here)))
    return sorted(out, key=repr)


def result(docs, **settings):
    found = dedup_lines(docs, **settings).select("row.doc_id", "text", "lines_removed").collect()
    return sorted(((repr(r[0]), r[1], r[2]) for r in found), key=repr)


def test_equals_plain_loops(spark, sf):
    docs = table(spark, sf, "documents")
    assert result(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def line(rng, words=9):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(words))


def test_planted_passages_of_every_length_are_removed_whole(make_docs):
    """Passages of 2 to 30 lines, each in three documents, shifted: the first stays whole."""
    rng = random.Random(11)
    passages = [[line(rng) for _ in range(n)] for n in (*range(2, 9), 13, 30) for _ in range(4)]
    passages += [[line(rng, 60)], [line(rng, 51)]]
    rows = []
    for passage in passages:
        for _ in range(3):
            own = [line(rng) for _ in range(rng.randrange(1, 6))]
            at = rng.randrange(len(own) + 1)
            rows.append((len(rows), "\n".join(own[:at] + passage + own[at:]), "en"))
    alone = [[line(rng, 50)], [line(rng, 4)]]  # single lines of no more than 50 words stay
    rows += [(len(rows) + k, "\n".join([line(rng), *a, line(rng)]), "en") for a in alone for k in (0, 1)]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    found = {int(d): (t, n) for d, t, n in result(make_docs(rows))}
    for k, passage in enumerate(passages):
        assert found[3 * k] == (rows[3 * k][1], 0)
        for doc in (3 * k + 1, 3 * k + 2):
            want = [x for x in rows[doc][1].split("\n") if x not in passage]
            assert found[doc] == ("\n".join(want), len(passage))
    assert all(n == 0 for d, (_, n) in found.items() if d >= 3 * len(passages))
    assert sorted(((repr(d), t, n) for d, (t, n) in found.items()), key=repr) == plain([r[:2] for r in rows])


A, B, C, D = (f"{x} {x} {x} {x} {x} {x}" for x in "ABCD")


def test_overlapping_passages_leave_a_first_occurrence_whole(make_docs):
    rows = [(1, f"{A}\n{B}", "en"), (2, f"{A}\n{B}\n{C}", "en"), (3, f"{B}\n{C}\n{D}", "en")]
    assert [r[1:] for r in result(make_docs(rows))] == [
        (f"{A}\n{B}", 0), (C, 2), (f"{B}\n{C}\n{D}", 0),
    ]
    rng = random.Random(5)
    pool = [line(rng) for _ in range(12)]
    for seed in range(3):
        rng = random.Random(seed)
        rows = []
        for doc in range(40):
            start, size = rng.randrange(12), rng.randrange(2, 9)
            lines = [pool[(start + k) % 12] for k in range(size)] + [line(rng)] * rng.randrange(2)
            rows.append((doc, "\n".join(lines), "en"))
        assert result(make_docs(rows)) == plain([r[:2] for r in rows])


def test_idioms_repeats_and_blank_lines(make_docs):
    rows = [
        (1, "a = 1\n}\n}\nb", "en"),
        (2, "c = 2\n}\n}\nd", "en"),
        (3, "yes\nno\n" * 30, "en"),
        (4, f"{A}\n\t\n{B}\n \r", "en"),
        (5, f"{A}\n{B}\nown", "en"),
        (6, f"{A}\n" * 5 + "end", "en"),
        (7, "aa bb\n\t", "en"),
        (8, "aa bb\n\t", "en"),
    ]
    found = result(make_docs(rows))
    assert found == plain([r[:2] for r in rows])
    kept = {int(d): (t, n) for d, t, n in found}
    assert kept[1][1] == kept[2][1] == kept[7][1] == kept[8][1] == 0
    assert kept[4][1] == 0 and kept[5] == ("own", 2)


def test_odd_documents(spark, odd_docs, no_docs):
    found = result(odd_docs)
    assert ("1", None, 0) in found and ("2", "", 0) in found and len(found) == odd_docs.count()
    # the nine words of the two rows with id 4 stand again under the null id
    assert [f[2] for f in found if f[0] in ("4", "None")] == [0, 0, 0]
    again = result(odd_docs, least_words=9)
    assert [f[1:] for f in again if f[0] == "None"] == [("", 3)]
    assert [f[2] for f in again if f[0] == "4"] == [0, 0]
    assert result(no_docs) == []


def test_repeated_ids_and_texts(make_docs):
    same = f"{A}\n{B}\n{C}"
    rows = [(9, same, "en"), (9, same, "en"), (9, f"{A}\n{B}", "en"), (None, same, "en"), (None, f"x\n{same}", "en")]
    found = result(make_docs(rows))
    texts = [t for d, t, n in found if d == "9" and n == 0]
    # one of the two texts of id 9 comes first; what the other shares with it goes
    assert sorted(texts) in ([same, same], [f"{A}\n{B}"])
    assert all(A not in t for d, t, n in found if d == "None")


def test_chunks_whose_hashes_meet_by_chance_stay(spark, make_docs, monkeypatch):
    """With a hash of the length alone, byte comparison keeps what only hashes alike."""
    real = F.xxhash64

    def poor(*columns):
        if len(columns) == 1 and not isinstance(columns[0], str):
            return F.length(columns[0]).cast("long")
        return real(*columns)

    monkeypatch.setattr(F, "xxhash64", poor)
    rows = [(1, f"{A}\n{B}", "en"), (2, f"{C}\n{D}", "en"), (3, "p q r s t u\nq q q q\nx", "en")]
    assert [r[2] for r in result(make_docs(rows))] == [0, 0, 0]


@pytest.mark.parametrize("least", [1, 30])
def test_least_words_is_a_parameter(make_docs, least):
    rows = [(1, "}\n}\nx y", "en"), (2, "}\n}\nz", "en"), (3, f"{A}\n{B}", "en"), (4, f"{A}\n{B}", "en")]
    assert result(make_docs(rows), least_words=least) == plain([r[:2] for r in rows], least)
