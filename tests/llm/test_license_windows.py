"""Licence notices that are no line, paragraph or whole text of their own."""

import random

import pytest

from tessera.llm import license

PROSE = "It was a long day at the harbour and nobody knew what the ship would bring"
RNG = random.Random(6)
LINES = [" ".join(RNG.sample(PROSE.lower().split() + [f"w{i}" for i in range(400)], 15)) for _ in range(60)]
MIT, APACHE, GPL = license.TEMPLATES["MIT"][2], license.TEMPLATES["Apache-2.0"][1], license.TEMPLATES["GPL-3.0"][2]


def parted(text, *starts):
    for s in starts:
        text = text.replace(s, "\n\n" + s)
    return text


CASES = [
    ("MIT", parted(MIT, "The above copyright", "THE SOFTWARE IS PROVIDED")),
    ("Apache-2.0", parted(APACHE, "You may obtain", "Unless required")),
    ("GPL-3.0", parted(GPL, "This program is distributed in").replace("program is free", "program  is free")),
    ("GPL-3.0", GPL.replace("This program is distributed", "\n\nThis program is distributed")),
    ("MIT", "Copyright 2020 Jane Doe. Licensed under the MIT License. See LICENSE for details."),
    ("MIT", "Licensed under the MIT license (https://opensource.org/licenses/MIT)"),
    ("MIT", "All of it is released under\nthe MIT License, as ever"),
]


@pytest.mark.parametrize(("name", "notice"), CASES)
def test_notice_within_other_text(name, notice):
    text = "\n".join([*LINES[:30], "", notice, "", *LINES[30:]])
    found = license.Scanner(license.TEMPLATES, 0.8).scan(text)
    windows = [f for f in found if f[2] == "window"]
    assert [f[0] for f in windows] == [name] and windows[0][1] >= 0.8
    last = 31 + notice.count("\n") + 1
    assert 32 <= windows[0][3] <= windows[0][4] <= last and windows[0][4] - windows[0][3] >= notice.count("\n") - 2


def test_plain_units_are_not_repeated():
    scanner = license.Scanner(license.TEMPLATES, 0.8)
    assert [f[2] for f in scanner.scan(PROSE + "\nReleased under the MIT License.\n" + PROSE)] == ["line"]
    assert scanner.windows(PROSE) == [] and scanner.windows("") == [] and scanner.windows("licensed under the") == []


def test_windows_against_every_window():
    """On noisy texts: wherever some run of words is a template, a window is found there, and every window found is one."""
    rng = random.Random(4)
    templates = {"A": ["a b c d e f g h"], "B": ["c d x y z"], "C": ["a a b a c"]}
    scanner = license.Scanner(templates, 0.8)
    for _ in range(400):
        words = [rng.choice("abcdefghxyz") if rng.random() < 0.5 else "abcdefghcdxyz"[i % 13] for i in range(rng.randint(1, 40))]
        found = scanner.windows(" ".join(words))
        value = {(i, j): max((license.dice(license.bigrams(" ".join(words[i : j + 1])), license.bigrams(t[0])), n) for n, t in templates.items()) for i in range(len(words)) for j in range(i + 1, len(words))}
        for name, d, i, j in found:
            assert d == pytest.approx(license.dice(license.bigrams(" ".join(words[i : j + 1])), license.bigrams(templates[name][0]))) and d >= 0.8
        for (i, j), (d, _n) in value.items():
            assert d < 0.8 or any(x <= j and i <= y for _, _, x, y in found)


def test_many_repeats_end():
    scanner = license.Scanner(license.TEMPLATES, 0.8)
    assert len(scanner.windows("Licensed under the MIT License. " * 5000)) == 5000
    half = " ".join(MIT.split()[:90])
    assert scanner.windows((half + " ") * 300) == []
