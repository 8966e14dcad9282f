"""License texts, notices and edited copies, against containment by brute force."""

import random

import pytest

from lodestar.llm import license

SCANNER = license.Scanner(license.templates())


def shingles(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def brute(template, words):
    """Whether a window holds 0.8 of the template's shingles and the license's name."""
    mine = license.words_of(template.text)
    width = license.width_of(mine)
    wanted, all_ = shingles(mine, width), shingles(words, width)
    n = len(wanted) + max(len(wanted) // 4, 1)
    for i in range(len(all_)):
        hits = [j for j in range(i, min(i + n, len(all_))) if all_[j] in set(wanted)]
        if hits and len({all_[j] for j in hits}) >= 0.8 * len(set(wanted)) - 1e-9 and set(license.words_of(template.name)) <= set(words[hits[0] : hits[-1] + width]):
            return True
    return False


@pytest.mark.parametrize("text, name", [("Licensed under the Apache License 2.0", "Apache-2.0"), ("MIT License", "MIT"), ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0"), ("Distributed under the Apache License, Version 2.0", "Apache-2.0"), ("published under the MIT license", "MIT"), ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0")])
def test_notices(text, name):
    assert [m["license"] for m in SCANNER(f"It is good prose. {text}. And so on it goes")] == [name]


def test_whole_texts_with_edits():
    r = random.Random(2)
    for t in license.templates()[len(license.NOTICES) :]:
        words = license.words_of(t.text)
        if len(words) > 100:
            edited = [f"edited{i}" if r.random() < 0.03 else w for i, w in enumerate(words)]
            found = [m for m in SCANNER("prose before " + " ".join(edited) + " prose after") if m["license"] == t.license]
            assert max(m["end"] - m["start"] for m in found) > 0.9 * len(" ".join(edited)), t.license


def test_edited_notices_same_as_brute_force():
    r = random.Random(1)
    held = 0
    for t in license.NOTICES:
        alone, words = license.Scanner((t,)), license.words_of(t.text)
        name = set(license.words_of(t.name))
        one = [words[:i] + ["edited"] + words[i + 1 :] for i in range(len(words))]
        if len(words) >= 5:
            assert all(alone(" ".join(x)) for x, w in zip(one, words, strict=True) if w not in name), t
        for _ in range(40):
            x = [w for w in words if r.random() > 0.12]
            for _ in range(r.randrange(5)):
                x.insert(r.randrange(len(x) + 1), r.choice(["and", "the", "mit", *words]))
            x = r.choices(words + ["prose"], k=r.randrange(9)) + x + r.choices(words, k=r.randrange(9))
            held += bool(alone(" ".join(x)))
            assert bool(alone(" ".join(x))) == brute(t, x), (t, x)
    assert 100 < held < 40 * len(license.NOTICES) - 100
