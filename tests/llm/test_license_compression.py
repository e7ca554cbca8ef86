import random

from casewright.llm import license_compression as scan
from tests.llm.frames import documents, empty

FILLER = random.Random(1)


def filler(n):
    return " ".join(FILLER.choice(["ka", "lo", "mitu", "the", "of", "under", "work", "is", "version"]) for _ in range(n))


def edit_distance(wanted, words):
    """Least differences between ``wanted`` and any run of ``words``."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(wanted, 1):
        new = [i]
        for j, h in enumerate(words, 1):
            new.append(min(row[j - 1] + (w != h), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_every_template_is_found_alone_and_inside_text():
    for name, text, _ in scan.wordings():
        if not name.endswith("+"):
            for around in ((0, 0), (300, 300)):
                before, after = filler(around[0]), filler(around[1])
                whole = f"{before}\n{text} {after}" if around[0] else text
                found = scan.scan(whole)
                assert [(f.license, f.differences) for f in found] == [(name, 0)], (name, text, found)
                best = found[0]
                assert best.saved > 0
                assert whole[best.start:best.end].split()[0].strip('"').lower() == text.split()[0].lower()


def test_several_licenses_changed_wording_and_near_misses():
    mit = scan.TEMPLATES["MIT"][2].replace("free of charge", "at no charge").replace("furnished", "given")
    text = f"{filler(50)} Licensed under the Apache License, Version 2.0. {filler(9)} Licensed under CC BY-NC 4.0. {mit}"
    got = [(f.license, f.differences) for f in scan.scan(text)]
    assert got == [("Apache-2.0", 0), ("CC-BY-NC-4.0", 0), ("MIT", 3)] or got == [("Apache-2.0", 0), ("CC-BY-NC-4.0", 0), ("MIT", 2)]
    assert [f.license for f in scan.scan("licensed under the\nGNU General Public License, version 2, work is")] == []
    for other in ("Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-ND 3.0.", "driving license of the driver",
                  "a copyright warranty permission", "licensed " * 3000, "", None):
        assert scan.scan(other) == []


def test_differences_equal_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        wanted = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
        words = [rng.choice("abcde") for _ in range(rng.randrange(0, 15))]
        count, first, last = scan.differences(wanted, words)
        assert count == edit_distance(wanted, words)
        run, full = words[first:last], [list(range(last - first + 1))]
        for i, w in enumerate(wanted, 1):
            full.append([i] + [0] * len(run))
            for j, h in enumerate(run, 1):
                full[i][j] = min(full[i - 1][j - 1] + (w != h), full[i - 1][j] + 1, full[i][j - 1] + 1)
        assert full[-1][-1] == count


def test_documents(spark):
    texts = ["Released under the MIT License.", None, "", "x " * 60_000 + "Released under the MIT License.", "İ Released under the MIT License."]
    docs = documents(spark, texts, licenses=1, spans=1)
    rows = {r.doc_id: r for r in scan.license_scan(docs.union(docs)).collect()}
    assert [rows[i].licenses for i in range(5)] == ["MIT", "", "", "MIT", "MIT"]
    assert rows[3].spans == "MIT:120000:120030:0" and rows[4].spans == "MIT:2:32:0"
    assert scan.license_scan(docs.union(docs)).count() == 10 and scan.license_scan(empty(spark)).count() == 0


#: Words of many shapes, so that filler and notice share nothing that a compressor could use.
VARIED = random.Random(5)


def varied(n):
    return " ".join("".join(VARIED.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(VARIED.randrange(3, 12))) for _ in range(n))


def exact_runs(text):
    """Brute force: (license, first word, last word) of every verbatim template."""
    words, places = scan.words_at(text)
    for name, wording, behind in scan.wordings():
        wanted = scan.words_at(wording)[0]
        for k in range(len(words) - len(wanted) + 1):
            if words[k:k + len(wanted)] == wanted and behind.match(text, places[k + len(wanted) - 1][1]):
                yield name, k, k + len(wanted)


def longest(runs):
    """Of runs that overlap the longest stays."""
    kept = []
    for run in sorted(runs, key=lambda r: (r[1] - r[2], r[1])):
        if all(run[2] <= k[1] or run[1] >= k[2] for k in kept):
            kept.append(run)
    return sorted(kept, key=lambda r: r[1])


def found_runs(text):
    starts = {a: k for k, (a, _) in enumerate(scan.words_at(text)[1])}
    ends = {b: k + 1 for k, (_, b) in enumerate(scan.words_at(text)[1])}
    return [(f.license, starts[f.start], ends[f.end]) for f in scan.scan(text)]


def test_verbatim_templates_among_varied_words_equal_brute_force():
    for _, text, _ in scan.wordings():
        for _ in range(4):
            whole = f"{varied(200)} {text} {varied(200)}"
            assert found_runs(whole) == longest(exact_runs(whole)) != [], whole


def test_an_identifier_is_read_to_its_end():
    for tag, want in [("MIT-0", "MIT-0"), ("MIT.", "MIT"), ("(MIT)", None), ("BSD-3-Clause-Clear", "BSD-3-Clause-Clear"),
                      ("GPL-2.0-or-later", "GPL-2.0-or-later"), ("GPL-2.0+", "GPL-2.0+"), ("GPL-2.0", "GPL-2.0"), ("MIT-unknown", None),
                      ("MPL-2.0-no-copyleft-exception", "MPL-2.0-no-copyleft-exception"), ("LGPL-3.0-only, and", "LGPL-3.0-only"),
                      ("Apache-2.0.1", None), ("ISC_x", None), ("CC-BY-NC-SA-4.0\n", "CC-BY-NC-SA-4.0")]:
        found = [f.license for f in scan.scan(f"{varied(9)} {scan.TAG}{tag} {varied(9)}")]
        assert found == ([want] if want else [] if tag != "(MIT)" else ["MIT"]), (tag, found)


def test_the_ranking_by_compression_decides(monkeypatch):
    """Wordings that contain each other: with the order turned round, the shorter one is reported."""
    texts = [text for _, text, _ in scan.wordings() if len(scan.words_at(text)[0]) > 60]
    whole = " ".join(f"{varied(150)} {text}" for text in texts)
    right = found_runs(whole)
    assert right == longest(exact_runs(whole))
    saving = scan.saving
    monkeypatch.setattr(scan, "saving", lambda template, words: -saving(template, words))
    wrong = found_runs(whole)
    assert wrong != right and sum(b - a for _, a, b in wrong) < sum(b - a for _, a, b in right)


def test_every_cue_of_a_short_text_is_looked_at():
    names = [(name, text) for name, text, _ in scan.wordings() if len(scan.words_at(text)[0]) < 15 and not name.endswith("+")]
    for name, text in names:
        for other in ("Check the license first", names[len(text) % len(names)][1]):
            whole = f"{other} {varied(30)} {text} {varied(30)} {text} {text}"
            assert found_runs(whole) == longest(exact_runs(whole)), whole
            assert [n for n, *_ in found_runs(whole)][-3:] == [name] * 3
