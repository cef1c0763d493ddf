"""What tokens that people make look like to the battery of `secrets`: the hypothesis that its claims reject.

`fit` makes a bounded sample for each encoding and length: SAMPLE made-up tokens (words of syllables in the
encoding's letters, capital letters where it has them, years, dates and counters, joined in several styles) and
as many uniform ones, takes the battery of both, and finds the direction that tells them apart best (Fisher's
linear discriminant). NULL holds what it found, scaled so that made-up tokens score about standard normal and
uniform ones lie far below. The table is not used row by row here; `secrets` reads it into expressions.
"""

from __future__ import annotations

import numpy as np

# Alphabets in the order of their symbols, and the places where a class of symbols begins.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
CLASSES = {"hex": (0, 10), "base32": (0, 26), "base36": (0, 10), "base62": (0, 26, 52), "base64": (0, 26, 52, 62)}
#: Lengths that parameters are fitted for; a token takes those of the largest that is not over its own. Tokens of each kind in a sample.
LENGTHS, SAMPLE, SEED = (14, 16, 20, 24, 32, 48, 64, 96), 3000, 77


def battery(token: str, name: str) -> np.ndarray:
    """Standard scores of one token of an alphabet's symbols: chi-squared of symbols, runs of classes, serial correlation, chi-squared of classes."""
    alphabet, starts = ALPHABETS[name], CLASSES[name]
    k, v = len(alphabet), np.array([alphabet.index(c) for c in token])
    n, share = len(v), np.diff([*starts, k]) / k
    chi = k / n * (np.bincount(v, minlength=k) ** 2).sum() - n
    of = np.searchsorted(starts, v, side="right") - 1
    same = (share**2).sum()
    changes = (of[1:] != of[:-1]).sum()
    off = v - v.mean()
    corr = (off[1:] * off[:-1]).sum() / (off**2).sum() if off.any() else 1.0
    kinds = (np.bincount(of, minlength=len(share)) ** 2 / (n * share)).sum() - n
    return np.array([(chi - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n), (changes - (n - 1) * (1 - same)) / np.sqrt((n - 1) * same * (1 - same)), (corr + 1 / n) * np.sqrt(n), (kinds - (len(share) - 1)) / np.sqrt(2 * (len(share) - 1))])


def made_up(r: np.random.Generator, name: str, n: int) -> str:
    """A token of n symbols as a person would make it: words and numbers, with a letter and a digit."""
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz" if c in ALPHABETS[name].lower()]
    vowels, others = [c for c in letters if c in "aeiou"], [c for c in letters if c not in "aeiou"]
    cased, share, style = name in ("base62", "base64"), r.choice([0.1, 0.25, 0.4]), r.integers(3)
    joint, out = r.choice(["/", "+"]) if name == "base64" else "", ""
    while len(out) < n:
        if r.random() < share:
            number = [str(r.integers(1970, 2030)), f"{r.integers(1990, 2030)}{r.integers(1, 13):02d}{r.integers(1, 29):02d}", str(r.integers(1000)), str(r.integers(100)).zfill(3)][r.integers(4)]
            unit = "".join(c for c in number if c in ALPHABETS[name])
        else:
            unit = "".join(r.choice(others) + r.choice(vowels) + (r.choice(others) if r.random() < 0.35 else "") for _ in range(r.integers(1, 5)))
            unit = unit[: max(3, r.integers(3, 10))]
            if cased and (style == 0 or not out or (style == 2 and r.random() < 0.5)):
                unit = unit.capitalize()
        out += unit + (joint if joint and r.random() < 0.7 else "")
    out = out[:n]
    if not any(c.isdigit() for c in out):
        out = out[: n - 4] + ("2024" if name != "base32" else "2426")
    return "Ab" + out[2:] if cased and not any(c.islower() for c in out) else out


def uniform(r: np.random.Generator, name: str, n: int) -> str:
    return "".join(r.choice(list(ALPHABETS[name]), n))


def fit(name: str, n: int) -> tuple[float, ...]:
    """Weights of the four scores and a constant: the sum is about standard normal for made-up tokens."""
    r = np.random.default_rng([SEED, n, *name.encode()])
    own, other = (np.array([battery(make(r, name, n), name) for _ in range(SAMPLE)]) for make in (made_up, uniform))
    w = np.linalg.solve(np.cov(own.T) + np.cov(other.T), own.mean(axis=0) - other.mean(axis=0))
    said = own @ w
    return tuple(float(x) for x in np.round([*(w / said.std()), -said.mean() / said.std()], 3))


#: What fit() finds: weights of the battery's scores and a constant, by encoding and length.
NULL = {
    "hex": {
        16: (0.108, -1.034, 0.496, 0.179, -5.173),
        20: (0.1, -1.081, 0.413, 0.102, -5.623),
        24: (0.123, -1.106, 0.379, 0.055, -5.995),
        32: (0.134, -1.237, 0.371, 0.009, -7.197),
        48: (0.147, -1.349, 0.323, -0.022, -8.91),
        64: (0.177, -1.281, 0.37, -0.035, -10.045),
        96: (0.206, -1.316, 0.404, -0.048, -12.745),
    },
    "base32": {
        14: (0.176, -1.063, 0.779, 0.058, -2.617),
        16: (0.194, -1.091, 0.714, 0.016, -2.755),
        20: (0.257, -1.195, 0.575, 0.016, -3.172),
        24: (0.312, -1.197, 0.514, -0.0, -3.494),
        32: (0.366, -1.129, 0.421, 0.023, -3.938),
        48: (0.382, -0.965, 0.372, -0.007, -4.433),
        64: (0.442, -0.828, 0.36, -0.008, -4.976),
        96: (0.446, -0.787, 0.393, -0.065, -6.186),
    },
    "base36": {
        14: (0.175, -1.487, 0.864, 0.025, -4.955),
        16: (0.177, -1.452, 0.802, 0.015, -5.121),
        20: (0.209, -1.619, 0.617, 0.009, -5.908),
        24: (0.198, -1.611, 0.534, 0.014, -6.373),
        32: (0.226, -1.544, 0.49, 0.005, -7.15),
        48: (0.273, -1.411, 0.417, -0.024, -8.119),
        64: (0.297, -1.392, 0.38, -0.043, -9.323),
        96: (0.325, -1.261, 0.386, -0.056, -10.903),
    },
    "base62": {
        14: (0.166, -0.925, 0.264, -0.015, -3.061),
        16: (0.138, -0.845, 0.246, -0.018, -2.99),
        20: (0.172, -0.8, 0.102, -0.035, -3.06),
        24: (0.175, -0.716, 0.107, -0.038, -3.057),
        32: (0.215, -0.622, 0.078, -0.044, -3.271),
        48: (0.291, -0.516, 0.022, -0.066, -3.62),
        64: (0.334, -0.487, 0.023, -0.081, -4.185),
        96: (0.35, -0.423, 0.035, -0.087, -4.963),
    },
    "base64": {
        14: (0.103, -0.777, 0.029, 0.129, -2.289),
        16: (0.132, -0.771, -0.088, 0.091, -2.339),
        20: (0.179, -0.755, -0.176, 0.07, -2.622),
        24: (0.208, -0.727, -0.224, 0.05, -2.823),
        32: (0.243, -0.633, -0.251, 0.019, -3.144),
        48: (0.308, -0.572, -0.251, -0.008, -4.223),
        64: (0.333, -0.515, -0.226, -0.032, -4.883),
        96: (0.39, -0.479, -0.182, -0.07, -6.428),
    },
}
