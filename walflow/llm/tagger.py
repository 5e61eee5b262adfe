"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

#: The order of kinds in results; the last is the tagger's own.
KINDS = ("email", "ip", "card", "phone", "key")
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k continues it
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHERS = "0123456789 \n@.-_+()=:;,/\"'#%$&*!?|"
ALPHABET = 2 + 2 * 26 + len(OTHERS)  # padding, any other character, letters of both cases, the rest
HIDDEN, WINDOW = 20, 128


def _codes() -> np.ndarray:
    out = np.ones(0x110000 + 1, np.uint8)
    for i, c in enumerate(LETTERS):
        out[ord(c)], out[ord(c.upper())] = 2 + i, 28 + i
    for i, c in enumerate(OTHERS):
        out[ord(c)] = 54 + i
    out[0x110000] = 0
    return out


CODES = _codes()
PAD = 0x110000


def encoded(text: str) -> np.ndarray:
    return CODES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(codes: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """codes: batch x time. Returns batch x time x HIDDEN and, if asked to keep it, what the backward pass needs."""
    n, steps = codes.shape
    h, c, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), []
    hs = np.empty((n, steps, HIDDEN), np.float32)
    for t in range(steps):
        z = w[codes[:, t]] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, g, tc))
        h = hs[:, t] = o * tc
    return hs, kept


def _lstm_back(codes: np.ndarray, u: np.ndarray, kept: list, dhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, steps = codes.shape
    dzs, before_h = np.empty((steps, n, 4 * HIDDEN), np.float32), np.stack([k[0] for k in kept])
    dh, dc = np.zeros_like(dhs[:, 0]), np.zeros_like(dhs[:, 0])
    for t in range(steps - 1, -1, -1):
        _, before, i, f, o, g, tc = kept[t]
        d = dh + dhs[:, t]
        dc = dc + d * o * (1 - tc * tc)
        dzs[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dh, dc = dzs[t] @ u.T, dc * f
    flat = dzs.reshape(-1, 4 * HIDDEN)
    which = (codes.T.reshape(-1, 1) == np.arange(ALPHABET)).astype(np.float32)
    return which.T @ flat, before_h.reshape(-1, HIDDEN).T @ flat


def _scores(p: dict[str, np.ndarray], codes: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
    a, ka = _lstm(codes, p["wf"], p["uf"], keep)
    b, kb = _lstm(codes[:, ::-1], p["wb"], p["ub"], keep)
    h = np.concatenate([a, b[:, ::-1]], 2)
    return h @ p["v"] + p["e"], (h, ka, kb)


def emissions(p: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The scores of the tags at each place of a batch of windows."""
    return _scores(p, codes, False)[0]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf(s: np.ndarray, y: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood by scores and transitions."""
    n, steps, k = s.shape
    a, b = np.zeros_like(s), np.zeros_like(s)
    a[:, 0] = s[:, 0]
    for t in range(1, steps):
        a[:, t] = _logsum(a[:, t - 1, :, None] + trans, 1) + s[:, t]
    for t in range(steps - 2, -1, -1):
        b[:, t] = _logsum(trans + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _logsum(a[:, -1], 1)
    ds = np.exp(a + b - z[:, None, None])
    dt = np.exp(a[:, :-1, :, None] + trans + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
    np.add.at(ds, (np.arange(n)[:, None], np.arange(steps), y), -1)
    np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
    return ds / n, dt / n


def best_tags(p: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """The best tag sequences (batch x time) by scores (batch x time x tags) and transitions, followed by an outside tag."""
    n, steps, _ = scores.shape
    best, back = scores[:, 0], np.zeros((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        x = best[:, :, None] + p["trans"]
        back[t] = x.argmax(1)
        best = x.max(1) + scores[:, t]
    out = np.zeros((n, steps), np.int8)
    out[:, -1] = (best + p["trans"][:, 0]).argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


def labelled(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text with its spans (kind, start, end): personal data in several spellings among words, numbers, dates, prices and versions."""
    r = random.Random(int(rng.integers(1 << 62)))
    pick, below = r.choice, r.randrange
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    word = lambda: "".join(pick(["an", "the", "er", "on", "re", "tion", "in", "ed", "st", "ou", "é", "ü", "ß", "o", "a", "ch", "qu"]) for _ in range(below(1, 5)))
    hexes = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(r.choices(LETTERS + LETTERS.upper() + "0123456789", k=n))
    name = lambda: "".join(r.choices(LETTERS, k=below(2, 9)))
    made = (
        lambda: (0, f"{name()}{pick(['.', '_', '', '-'])}{pick([name(), digits(2), digits(1)])}@{name()}{pick(['', digits(1)])}.{pick(['com', 'org', 'example.com', 'co.uk', 'net'])}"),
        lambda: (1, ".".join(str(below(256)) for _ in range(4))),
        lambda: (2, pick([digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)), digits(15)])),
        lambda: (3, pick(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+1-{}-{}-{}", "{}.{}.{}", "+44 {} {} {}", "{} {} {}"]).format(digits(3), digits(3), digits(4))),
        lambda: (4, pick([mixed(below(20, 41)), hexes(below(24, 41)), f"AKIA{mixed(16).upper()}", f"ghp_{mixed(36)}"])),
    )
    plain = (lambda: str(below(1, 3000)), lambda: f"{below(1, 99)}.", lambda: f"{below(1990, 2031)}-{digits(2)}-{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"{word()} %%%", lambda: f"#{digits(5)}", lambda: f"{digits(2)}:{digits(2)}", lambda: word().upper() + "!!", lambda: f"{digits(6)} {word()}")
    text, spans = "", []
    for _ in range(below(6, 22)):
        u = r.random()
        if u < 0.12:
            kind, s = pick(made)()
            lead = pick(["token=", "key: ", 'api_key = "', "secret ", ""]) if kind == 4 else pick(["", "", "", "tel: ", "("])
            text += lead
            spans.append((kind, len(text), len(text) + len(s)))
            text += s + pick(["", "", ".", ",", '"', ";"])
        else:
            text += pick(plain)() if u < 0.3 else pick([word(), word().capitalize(), word() + ",", word() + ".", word() + " |"])
        text += pick([" ", " ", " ", " ", "\n"])
    return text, spans


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


@lru_cache(maxsize=2)
def trained(steps: int = 260, batch: int = 48, seed: int = 7) -> dict[str, np.ndarray]:
    """The tagger's weights, fitted by Adam on batch * steps labelled windows; the same for the same arguments, and kept for the process."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.normal(size=s) * 0.15).astype(np.float32)
    p = {"wf": init(ALPHABET, 4 * HIDDEN), "wb": init(ALPHABET, 4 * HIDDEN), "uf": init(HIDDEN, 4 * HIDDEN), "ub": init(HIDDEN, 4 * HIDDEN), "v": init(2 * HIDDEN, TAGS), "e": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    m, s2 = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    length = 64
    for step in range(1, steps + 1):
        xs, ys = [], []
        while len(xs) < batch:
            text, spans = labelled(rng)
            x, y = encoded(text), tags_of(len(text), spans)
            at = int(rng.integers(-8, max(1, len(x) - length // 2)))
            px, py = np.zeros(length, np.uint8), np.zeros(length, np.int64)
            a, b = max(0, at), min(len(x), at + length)
            px[a - at : b - at], py[a - at : b - at] = x[a:b], y[a:b]
            xs.append(px)
            ys.append(py)
        codes, y = np.stack(xs), np.stack(ys)
        s, (h, ka, kb) = _scores(p, codes, True)
        ds, dt = _crf(s, y, p["trans"])
        ds = ds.astype(np.float32)
        dh = ds @ p["v"].T
        g = {"v": np.einsum("nth,ntk->hk", h, ds), "e": ds.sum((0, 1)), "trans": dt}
        g["wf"], g["uf"] = _lstm_back(codes, p["uf"], ka, dh[:, :, :HIDDEN])
        g["wb"], g["ub"] = _lstm_back(codes[:, ::-1], p["ub"], kb, dh[:, ::-1, HIDDEN:])
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for k, x in g.items():
            x = x * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            s2[k] = 0.99 * s2[k] + 0.01 * x * x
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    for k in range(len(KINDS)):  # a kind continues only itself
        ok = np.zeros(TAGS, bool)
        ok[[1 + 2 * k, 2 + 2 * k]] = True
        p["trans"][~ok, 2 + 2 * k] = -1e4
    return p
