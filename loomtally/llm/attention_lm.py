"""A small causal self-attention model in numpy, over words read as subword ids.

An input is a word: the mean affinity of its subword ids to the kinds of
documents, through a learned layer. One attention layer with a bias for each
distance looks back over the words before. Its output weighs the experts that
spell the next word, one for each kind, and one more that copies a word from
where the attention looks. All weights add up to one, and so do the
probabilities of all next words.
"""

from __future__ import annotations

import numpy as np

#: Words of context before the scored ones, and words scored in one window.
BEFORE, SCORED = 16, 48
SPAN = BEFORE + SCORED
WIDTH = 16


def start(prior: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that attend to all words alike and weigh each kind by the affinity of what was seen."""
    rng = np.random.default_rng(seed)
    kinds = len(prior)

    def near(*shape: int) -> np.ndarray:
        return rng.normal(0, 0.1 * shape[0] ** -0.5, shape).astype(np.float32)

    p = {
        "P": near(kinds, WIDTH), "c": np.zeros(WIDTH, np.float32), "Q": near(WIDTH, WIDTH), "K": near(WIDTH, WIDTH),
        "V": near(WIDTH, WIDTH), "R": np.zeros(SPAN, np.float32), "O": near(2 * WIDTH, kinds + 1),
        "o": np.append(np.log(np.maximum(prior, 1e-6)), -3.0).astype(np.float32),
    }
    same = np.arange(min(kinds, WIDTH))
    p["P"][same, same] += 1
    p["V"][same, same] += 1
    p["O"][WIDTH + same, same] += 6
    return p


_I, _J = np.arange(SCORED)[:, None], np.arange(SPAN)[None, :]
#: How far back key j is from query i (queries are the last SCORED inputs).
_BACK = BEFORE + _I - _J
_SEEN = _BACK >= 0
_BACK = np.where(_SEEN, _BACK, 0)
_BACK_SEEN = _BACK[_SEEN]


def embed(p: dict[str, np.ndarray], affinity: np.ndarray) -> np.ndarray:
    return np.tanh(affinity @ p["P"] + p["c"])


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, as a product: several times faster than ``sum`` for short rows."""
    return x @ np.ones(x.shape[-1], dtype=x.dtype)


def keyed(x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Embedded inputs with two columns more: one that hides padding (``real`` is 0 there) from all queries, and ones."""
    return np.concatenate([x, ((real - 1) * np.float32(1e9))[..., None], np.ones((*x.shape[:-1], 1), x.dtype)], axis=-1, dtype=x.dtype)


def products(p: dict[str, np.ndarray], dtype=np.float32):
    """What ``forward`` needs of parameters: what an input as a query looks for and adds to the weights, what a found one adds, and biases."""
    value = p["V"] @ p["O"][WIDTH:]
    both = np.zeros((WIDTH + 2, WIDTH + 2 + value.shape[1]), dtype=dtype)
    both[:WIDTH, :WIDTH], both[:WIDTH, WIDTH + 2 :] = (p["Q"] @ p["K"].T) * np.float32(WIDTH**-0.5), p["O"][:WIDTH]
    both[-1, WIDTH], both[-1, WIDTH + 2 :] = 1, p["o"]
    return both, value, np.where(_SEEN, p["R"][_BACK], np.float32(-1e9)).astype(dtype)


def forward(made_of, keys: np.ndarray):
    """Weights of the experts at the last SCORED of SPAN inputs of each window, and where they look, with the sums of that.

    ``keys`` holds inputs as ``keyed`` lays them, ``made_of`` the ``products`` of parameters.
    """
    both, value, bias = made_of
    n, kinds = len(keys), value.shape[1]
    made = (keys.reshape(-1, WIDTH + 2) @ both).reshape(n, SPAN, -1)[:, BEFORE:]
    look = made[..., : WIDTH + 2]
    s = look @ keys.transpose(0, 2, 1)
    s += bias
    if s.max(initial=0) > 60:
        np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    found = s @ keys
    total = found[..., -1:] + np.float32(1e-6)
    found = found[..., :WIDTH] / total
    z = (found.reshape(-1, WIDTH) @ value).reshape(n, SCORED, kinds)
    z += made[..., WIDTH + 2 :]
    # The largest of few columns: rows of columns are compared, which is faster than within each short row.
    z -= np.ascontiguousarray(z.reshape(-1, kinds).T).max(axis=0).reshape(n, SCORED, 1)
    np.exp(z, out=z)
    z /= _sums(z)[..., None]
    return z, s, total, look, found


def copies(words: np.ndarray, s: np.ndarray, total: np.ndarray):
    """Where a query's key is the very word that comes next (as ones), and how much of the query looks there."""
    same = (words[:, None, :-1] == words[:, BEFORE + 1 :, None]).astype(s.dtype)
    return same, np.einsum("bij,bij->bi", s, same) / total[..., 0]


def log_mixture(z: np.ndarray, copied: np.ndarray, top: np.ndarray, likelihood: np.ndarray):
    """Natural log of what the experts together give each word.

    An expert of kind k gives a word exp(top) * likelihood[k], the last expert ``copied``.
    """
    spelt = np.log(_sums(z[..., :-1] * likelihood) + np.float32(1e-30)) + top
    with np.errstate(divide="ignore"):
        return np.logaddexp(spelt, np.log(z[..., -1].astype(np.float64) * copied)), spelt


def gradients(p, affinity, words, real, top, likelihood, valid):
    """Mean log loss and gradients for windows of SPAN inputs, of which the last SCORED foretell the word after them.

    ``words`` numbers the SPAN + 1 words of each window.
    """
    flat = lambda a: a.reshape(-1, a.shape[-1])
    affinity = flat(affinity)
    x = embed(p, affinity).reshape(*real.shape, WIDTH)
    keys = keyed(x, real)
    both, value, _ = made_of = products(p, keys.dtype)
    z, s, total, look, found = forward(made_of, keys)
    same, copied = copies(words, s, total)
    every, spelt = log_mixture(z, copied, top, likelihood)
    n = max(1.0, float(valid.sum()))
    loss = -float((every * valid).sum()) / n
    share = np.exp(spelt - every).astype(np.float32)
    own = z[..., :-1] * likelihood
    own *= (share / (_sums(own) + np.float32(1e-30)))[..., None]
    each = (valid / np.float32(n))[:, :, None]
    dz = (z - np.concatenate([own, 1 - share[..., None]], axis=-1)) * each
    # Of each query: what its weights gain by the values found, less their mean under the weights, all over the sum of these.
    dfound = (flat(dz) @ value.T).reshape(found.shape)
    dcopied = (1 - share) / np.maximum(copied, np.float32(1e-9)) * each[..., 0]
    gain = np.empty_like(look, order="C")
    np.divide(dfound, total, out=gain[..., :WIDTH])
    gain[..., WIDTH] = 0
    gain[..., -1] = (dcopied * copied - _sums(dfound * found)) / total[..., 0]
    ds = gain @ keys.transpose(0, 2, 1)
    same *= (dcopied / total[..., 0])[..., None]
    ds -= same
    ds *= s
    dmade = np.concatenate([ds @ keys, dz], axis=-1, dtype=ds.dtype)
    dx = ds.transpose(0, 2, 1) @ look[..., :WIDTH]
    dx += s.transpose(0, 2, 1) @ gain[..., :WIDTH]
    dx[:, BEFORE:] += (flat(dmade) @ both[:WIDTH].T).reshape(found.shape)
    dboth, dvalue = flat(keys[:, BEFORE:]).T @ flat(dmade), flat(found).T @ flat(dz)
    dmatch = dboth[:WIDTH, :WIDTH] * np.float32(WIDTH**-0.5)
    over = np.ones(len(ds), dtype=ds.dtype) @ ds.reshape(len(ds), -1)
    x *= x
    np.subtract(1, x, out=x)
    dx *= x
    return loss, {
        "P": affinity.T @ flat(dx), "c": np.ones(x.shape[0] * SPAN, dx.dtype) @ flat(dx),
        "Q": dmatch @ p["K"], "K": dmatch.T @ p["Q"], "V": dvalue @ p["O"][WIDTH:].T,
        "R": np.bincount(_BACK_SEEN, weights=over.reshape(SCORED, SPAN)[_SEEN], minlength=SPAN).astype(np.float32),
        "O": np.concatenate([dboth[:WIDTH, WIDTH + 2 :], p["V"].T @ dvalue]), "o": dboth[-1, WIDTH + 2 :],
    }


def descend(p, affinity, words, top, likelihood, rate: float, batch: int = 32, seed: int = 3):
    """One pass of Adam over windows of SPAN + 1 words; returns new parameters and the mean loss.

    ``affinity`` and ``words`` (below zero: padding) are of all words of a window,
    ``top`` and ``likelihood`` of the last SCORED.
    """
    rng = np.random.default_rng(seed)
    # All parameters lie in one array, of which ``p`` has the parts.
    ends = np.cumsum([v.size for v in p.values()])
    own = np.concatenate([v.ravel() for v in p.values()])
    p = {k: own[end - v.size : end].reshape(v.shape) for (k, v), end in zip(p.items(), ends.tolist(), strict=True)}
    m1, m2 = np.zeros_like(own), np.zeros_like(own)
    losses = []
    order = rng.permutation(len(words))
    for t, i in enumerate(range(0, len(order), batch), 1):
        at = order[i : i + batch]
        w = words[at]
        real, valid = (w[:, :-1] >= 0).astype(np.float32), (w[:, BEFORE + 1 :] >= 0).astype(np.float32)
        loss, g = gradients(p, affinity[at, :-1], w, real, top[at], likelihood[at], valid)
        losses.append(loss)
        g = np.concatenate([g[k].ravel() for k in p])
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        own -= np.float32(rate / (1 - 0.9**t)) * m1 / (np.sqrt(m2 / (1 - 0.99**t)) + np.float32(1e-8))
    return p, float(np.mean(losses)) if losses else 0.0


def windows(begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of texts laid one after another, ``n`` words in all: where its text begins, its scored words begin, its text ends."""
    lens = np.diff(np.append(begins, n))
    counts = -(-lens // SCORED)
    first = np.repeat(begins, counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first, first + SCORED * nth, np.repeat(begins + lens, counts)


def laid(words: np.ndarray, first: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the SPAN + 1 words of each window; the number is below zero outside its text."""
    place = at[:, None] + np.arange(-BEFORE - 1, SCORED)
    inside = (place >= first[:, None]) & (place < ends[:, None])
    return place, np.where(inside, words[np.clip(place, 0, len(words) - 1)], -1).astype(np.int32)


def log_words(p, affinity: np.ndarray, words: np.ndarray, top: np.ndarray, likelihood: np.ndarray, begins: np.ndarray, chunk: int = 32):
    """log P(word | the words before it in its text), for texts laid one after another; texts begin at ``begins``.

    ``words`` numbers each word in ``affinity``, ``top`` and ``likelihood``. A text is
    cut into windows that overlap by BEFORE words; those of a window's second part are
    scored there and nowhere else. Windows are scored in batches, padding masked.
    """
    n = len(words)
    out = np.empty(n, dtype=np.float64)
    first, at, ends = windows(begins, n)
    # The last row stands for padding.
    vectors = embed(p, np.concatenate([affinity, np.zeros((1, affinity.shape[1]), np.float32)]))
    vectors = keyed(vectors, np.arange(len(vectors)) < len(affinity))
    made_of = products(p, vectors.dtype)
    for i in range(0, len(at), chunk):
        here = slice(i, i + chunk)
        place, w = laid(words, first[here], at[here], ends[here])
        inside = w >= 0
        z, s, total, _, _ = forward(made_of, vectors.take(w[:, :-1], axis=0, mode="wrap"))
        copied = copies(w, s, total)[1]
        keep = inside[:, BEFORE + 1 :]
        aims = w[:, BEFORE + 1 :]  # the last word's in place of padding, whose results are left out
        out[place[:, BEFORE + 1 :][keep]] = log_mixture(z, copied, top[aims], likelihood[aims])[0][keep]
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def spread_out(x: np.ndarray, k: int, seed: int = 9) -> np.ndarray:
    """At most ``k`` rows of ``x`` that are far apart, to begin a clustering with."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    far = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < k and far.sum() > 0:
        at.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at].astype(float)
