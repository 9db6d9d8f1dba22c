"""Labelled spans for the boosted trees: personal data and look-alikes planted into a bounded sample of corpus texts."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np

from quillgraph.llm import boosted_trees
from quillgraph.llm.pii_candidates import AGAINST, CUES, KINDS, N_FEATURES, base_spans, candidates, features, luhn, mod97


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _pattern(rng: random.Random, *forms: str) -> str:
    """One form with each 0 a digit, each N a digit from 2 to 9, each x a hex digit, each X a capital."""
    fill = {"0": "0123456789", "N": "23456789", "x": "0123456789abcdef", "X": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return "".join(rng.choice(fill[c]) if c in fill else c for c in rng.choice(forms))


def _word(rng: random.Random, low: int = 3, high: int = 9) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))


def _email(rng):
    at = rng.choice([" at ", "(at)", " (at) ", "[at]", " [at] ", " @ ", "&#64;", " AT "])
    dot = rng.choice([" dot ", "(dot)", "[dot]", " [dot] "]) if "&" not in at and "@" not in at else "."
    dot = "." if rng.random() < 0.2 and at.strip() in ("(at)", "[at]") else dot
    user = _word(rng) + rng.choice(["", ".", "_", "-"]) + rng.choice([_word(rng), _digits(rng, 2), ""])
    return user + at + dot.join([_word(rng), rng.choice([_word(rng, 2, 3), "com", "org", "net", "example"]), "com"][rng.randint(0, 1) :])


def _not_email(rng):
    plain = [f"{_word(rng)} at {_word(rng)}.{_word(rng).capitalize()}", f"{_word(rng)} at {_word(rng)}. {_word(rng)}", f"{_word(rng)} at {_digits(rng, 1)}.{_digits(rng, 2)}", f"{_word(rng)} @ {_digits(rng, 2)}.{_digits(rng, 2)}", f"look at {_word(rng)} dot {_word(rng)} matrix", f"{_digits(rng, 3)} @ {_digits(rng, 1)}.{_digits(rng, 2)}"]
    return rng.choice(plain)


def _ip(rng):
    parts = [format(rng.randrange(1, 1 << 16), "x") for _ in range(8)]
    short = ":".join(parts[: rng.randint(1, 3)]) + "::" + ":".join(parts[5 : 5 + rng.randint(1, 3)])
    v4 = rng.choice(["[.]", "(.)", " [.] "]).join(str(rng.randint(1, 255)) for _ in range(4))
    return rng.choice([":".join(parts), short, "2001:db8::" + parts[0] + ":" + parts[1], "fe80::" + ":".join(parts[:4]), v4])


def _not_ip(rng):
    return rng.choice([_pattern(rng, "12:00:00", "00:00:00", "10:00:00", "0:00:00", "0:0:0:0", "1:0:00:00"), f"{_word(rng)}::{_word(rng)}", "::", f"a::{_word(rng, 2, 4)}", "abc::def", ":::", "1::2"])


def _with_luhn(digits: str) -> str:
    return next(digits[:-1] + c for c in "0123456789" if luhn(digits[:-1] + c))


def _grouped(digits: str, sizes: list[int], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return mark.join(out)


def _card(rng):
    if rng.random() < 0.5:
        number = _with_luhn(rng.choice(["34", "37"]) + _digits(rng, 13))
        return rng.choice([number, _grouped(number, [4, 6, 5], " "), _grouped(number, [4, 6, 5], "-")])
    number = _with_luhn(rng.choice("45") + _digits(rng, 15))
    return _grouped(number, [4, 4, 4, 4], rng.choice([".", "/", ". "]))


def _not_card(rng):
    number = _digits(rng, rng.randint(12, 19))
    wrong = number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)
    date = f"20{_pattern(rng, '00')}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}{rng.randint(0, 23):02d}{rng.randint(0, 59):02d}{rng.randint(0, 59):02d}"
    return rng.choice([wrong, wrong, number[:14], "978" + _digits(rng, 10), date, _grouped(wrong + "0" * 16, [4, 4, 4, 4], rng.choice([" ", "-", "."])), _pattern(rng, "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"), "1" + _digits(rng, 12)])


def _phone(rng):
    return _pattern(rng, "(N00) N00-0000", "(N00)N00-0000", "N00-N00-0000", "N00.N00.0000", "1-N00-N00-0000", "N00 N00 0000", "1 (N00) N00-0000", "(0N0) N000 0000", "0N00 000000", "0049 N0 0000000", "0033 N 00 00 00 00", "0N0-0000000", "0N 00 00 00 00")


def _not_phone(rng):
    y, m, d = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice([
        f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d:02d}.{m:02d}.{y}", f"{y}{m:02d}{d:02d}", f"{y} {y + 1} {y + 2}", f"{y}-{y + 3}", f"{y}-{m:02d}-{d:02d} {_pattern(rng, '10:00')}",
        _pattern(rng, "0-000-00000-0", "978-0-000-00000-0", "0000-0000", "N,000,000.00", "N00,000,000", "N.000.0000", "00.000000", "0.00000000", "0000000", "00000000", "000000000", "0000000000", "000-0000-00", "0000-00-000", "N00/N000/00", "00 00 00 00 00 00 00", "0 0 0 0 0 0 0 0 0", "10.0000/000000", "N000-N000, 0000", "00, 000, 0000"),
        _pattern(rng, "xxxxxxxxxxxx0000000xxxxx", "XX0000000", "XXX-000-0000", "000-000-0000-XX", "v0.00.0000", "00000000000000000000000"),
    ])


def _ssn(rng):
    return f"{rng.choice([n for n in (rng.randint(1, 899), 123) if n != 666]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"


def _not_ssn(rng):
    return rng.choice([_pattern(rng, "000000000", "N00000000", "000 000 000", "00-000-0000", "0000-00-000", "00.000.0000"), f"{rng.choice(['000', '666', '9' + _digits(rng, 2)])}-{_digits(rng, 2)}-{_digits(rng, 4)}", f"{_digits(rng, 3)}-00-{_digits(rng, 4)}", _pattern(rng, "X000-00-0000", "000-00-0000-0", "000/00/0000")])


def _iban(rng):
    body = _pattern(rng, "XXXX00000000000000", "000000000000000000", "0000000000000000", "00000000000000000000", "00000XXXX000000000000000")
    country = rng.choice(["DE", "GB", "FR", "ES", "IT", "NL", "CH"])
    code = next(f"{country}{c:02d}{body}" for c in range(100) if mod97(f"{country}{c:02d}{body}"))
    return " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if rng.random() < 0.5 else code


def _not_iban(rng):
    return _pattern(rng, "XX00000000000000", "XX00XXXX000000000000", "XX00 0000 0000 0000", "XX0000000000000000000", "XX00XXXXXXXXXXXX")


MAKERS: tuple[tuple[Callable, Callable], ...] = ((_email, _not_email), (_ip, _not_ip), (_card, _not_card), (_phone, _not_phone), (_ssn, _not_ssn), (_iban, _not_iban))


def plant(rng: random.Random, context: str) -> tuple[str, int, int, int, bool]:
    """A text, the kind, place and truth of what was planted into a context at a gap between words."""
    kind, true = rng.randrange(len(KINDS)), rng.random() < 0.45
    span = MAKERS[kind][not true](rng)
    if len(context) > 40 and rng.random() < 0.9:
        at = context.find(" ", rng.randrange(len(context))) + 1
    else:
        at = 0
    cues = CUES[kind] if rng.random() < (0.45 if true else 0.08) else AGAINST if rng.random() < (0.02 if true else 0.4) else ()
    cue = rng.choice(cues) + rng.choice([" ", ": ", " is ", " number "]) if cues else ""
    tail = rng.choice(["", "", ".", ",", ")", "!", "###", "\n", ";", '"'])
    text = context[:at] + cue + span + tail + (" " + context[at:] if context[at:] else "")
    return text, kind, at + len(cue), at + len(cue) + len(span), true


def examples(contexts: list[str], many: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, kinds and items of the candidates that touch what was planted."""
    rng = random.Random(seed)
    contexts = contexts or [""]
    x, y, kinds, items = [], [], [], []
    for item in range(many):
        text, kind, start, end, true = plant(rng, rng.choice(contexts))
        for k, s, e in candidates(text, base_spans(text)):
            if s < end and start < e:
                x.append(features(text, k, s, e)), y.append(true and (k, s, e) == (kind, start, end)), kinds.append(k), items.append(item)
    return np.array(x, float).reshape(-1, N_FEATURES), np.array(y, float), np.array(kinds, int), np.array(items, int)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (lowest score, share of true ones) of the rising fit to labels by score: pool adjacent violators."""
    levels, of = np.unique(score, return_inverse=True)
    steps: list[list[float]] = []  # lowest score, sum, count
    for step in zip(levels.tolist(), np.bincount(of, y).tolist(), np.bincount(of).tolist()):
        steps.append(list(step))
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1][1] += last[1]
            steps[-1][2] += last[2]
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def fit(contexts: list[str], many: int, precision: float, seed: int = 7) -> dict:
    """Trees learnt on two thirds of the planted items; steps of probability and the thresholds by kind from the rest."""
    x, y, kinds, items = examples(contexts, many, seed)
    held = items % 3 == 0
    model = boosted_trees.fit(x[~held], y[~held], rounds=80, depth=5)
    score = boosted_trees.predict(model, x)
    steps = []
    for k in range(len(KINDS)):
        of = held & (kinds == k)
        low, share = isotonic(score[of], y[of]) if of.any() else (np.zeros(0), np.zeros(0))
        enough = np.flatnonzero(share >= precision)
        steps.append((low, share, float(low[enough[0]]) if len(enough) else np.inf))
    return {"trees": model, "steps": steps}
