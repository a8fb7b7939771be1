"""Licence matches, chains and labels against brute force."""

import random

import numpy as np

from braidflow.llm import license_scan

SCANNER = license_scan.Scanner(license_scan.TEMPLATES, license_scan.BASE_PHRASES)


def scan(text, scanner=SCANNER):
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return next(iter(license_scan.scan_block(scanner, data, np.array([0, len(data)]))))[1]


def diagonal_runs(text, template, least):
    """Every run of equal tokens that neither neighbour extends."""
    out = set()
    for lead in range(-len(text), len(template) + 1):
        at = 0
        while at < len(text):
            stop = at
            while stop < len(text) and 0 <= stop + lead < len(template) and text[stop] == template[stop + lead]:
                stop += 1
            if stop - at >= least:
                out.add((at, stop, at + lead, stop + lead))
            at = max(stop, at + 1)
    return out


def best_chain(matches, sums, max_gap):
    """Over all sequences of matches."""
    best = 0.0

    def go(last, weight):
        nonlocal best
        best = max(best, weight)
        for m in matches:
            skip = max(0, last[1] - m[0], last[3] - m[2])
            if m > last and skip < m[1] - m[0] and m[0] + skip - last[1] <= max_gap:
                go(m, weight + sums[m[3]] - sums[m[2] + skip])

    for m in matches:
        go(m, sums[m[3]] - sums[m[2]])
    return best


def test_every_maximal_match_of_every_template_is_found():
    rng = random.Random(3)
    for _ in range(200):
        templates = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        text = [rng.randrange(5) for _ in range(30)]
        found = list(license_scan.SuffixAutomaton(templates).matches(text, 2))
        got = {(k, a, b, end - (b - a), end) for a, b, k, end in found}
        assert len(found) == len(got)
        assert got == {(k, *m) for k, t in enumerate(templates) for m in diagonal_runs(text, t, 2)}


def test_the_heaviest_chain_is_found():
    rng = random.Random(4)
    for _ in range(150):
        template = [rng.randrange(3) for _ in range(8)]
        text = [rng.randrange(4) for _ in range(14)]
        sums = np.concatenate(([0.0], np.cumsum([rng.choice((0.5, 1.0, 2.5)) for _ in template])))
        matches = sorted(diagonal_runs(text, template, 2))
        got = license_scan.chains(matches, sums, max_gap=2)
        assert abs(max((w for w, *_ in got), default=0.0) - best_chain(matches, sums, 2)) < 1e-9
        assert sum(w for w, *_ in got) <= sum(sums[m[3]] - sums[m[2]] for m in matches) + 1e-9


def test_stock_words_give_no_label_and_names_do():
    for text in ("licensed under the terms of apache", "released under the terms of the GPL", "released under the apache licence", "licensed under the license", "permission is hereby given", "licensed under the foo license", "released under the same terms", ""):
        assert scan(text)["labels"] == [], text
    for text, label in (
        ("licensed under the BSD license", "bsd"), ("Licensed under the GNU General Public License, version 3.", "gpl-3"), ("under the GNU General Public License version 2", "gpl-2"), ("GNU Affero General Public License version 3", "agpl-3"),
        ("licensed under the GNU Lesser General Public License, version 3", "lgpl"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY 4.0", "cc-by"), ("All rights reserved.", "proprietary"),
    ):
        assert scan(text)["labels"] == [label], text


def test_each_template_alone_and_edited_has_its_label():
    rng = random.Random(5)
    for label, template in license_scan.TEMPLATES:
        found = scan(template)
        assert found["labels"] == sorted({label, *found["base"]}) and found["score"] == 1.0
        words = template.split()
        if len(words) >= 17:
            for _ in range(len(words) // 12):
                words.insert(rng.randrange(len(words)), "zzz")
            assert scan(" ".join(words))["labels"] == [label], words
    notice = "Copyright 2020 X. All rights reserved. " + next(t for k, t in license_scan.TEMPLATES if k == "bsd" and t.startswith("redistribution and"))
    assert scan(notice)["labels"] == ["bsd"]


def test_names_of_the_commons_and_short_forms():
    for text, labels in (
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc", "cc-by-nc-sa"]),  # the base phrase stays
        ("CC BY-SA", ["cc-by-sa"]), ("cc by nd", ["cc-by-nd"]), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", ["cc-by-nc-nd"]), ("CC0 1.0 Universal", ["cc0-1"]),
        ("Boost Software License - Version 1.0", ["bsl-1"]), ("MIT License", ["mit"]), ("SPDX-License-Identifier: MIT", ["mit"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2"]), ("spdx-license-identifier: cc-by-4.0", ["cc-by"]),
        ("SPDX-License-Identifier: Zlib", ["zlib"]), ("This program is made available under the terms of the Eclipse Public License v. 2.0", ["epl-2"]), ("SPDX-License-Identifier: unknown", []), ("the license identifier of the software", []),
        ("a copy of the software and the documentation", []), ("creative commons", []), ("version 2 0", []),
    ):
        assert scan(text)["labels"] == labels, text


def test_whole_texts_are_one_span():
    texts = license_scan.license_texts
    for label, text in texts.WHOLE:
        n = len(texts.words(text).split())
        found = scan(f"Some code. Copyright 2020 A. Person\n\n{text}\n\nmore code follows here")
        assert found["labels"] == [label] and found["score"] == 1.0
        assert any(b - a == n and part == 1.0 for a, b, _, part in found["spans"]), (label, found["spans"])
    half = " ".join(texts.BOOST.split()[:120])
    assert scan(half)["labels"] == ["bsl-1"]


def test_notices_side_by_side_are_spans_of_their_own():
    mit, gpl = "released under the mit license", "licensed under the gnu general public license version 3"
    found = scan(f"zzz {mit} {mit} zzz {gpl}")
    assert found["labels"] == ["gpl-3", "mit"]
    assert [(a, b, label) for a, b, label, _ in found["spans"]] == [(1, 6, "mit"), (6, 11, "mit"), (12, 21, "gpl-3")]
    assert len(scan(f"{mit} " * 3000)["spans"]) == 3000


def test_base_places_are_of_whole_phrases():
    """The phrases as the contract writes them, not as the module does."""
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    rng = random.Random(6)
    words = sorted({w for p in phrases.values() for w in p.split()} | {"by-nc", "zzz"})
    texts = ["see the MIT License", "Under the\nMIT license. Under, the MIT-license", "the mit license under the mit", *(" ".join(rng.choices([*words, *phrases.values()], k=30)) for _ in range(50))]
    for text in texts:
        w, found = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split(), scan(text)
        hits = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for label, p in phrases.items()}
        assert found["places"] == sorted(i for at in hits.values() for i in at), text
        assert found["base"] == sorted(label for label, at in hits.items() if at), text
