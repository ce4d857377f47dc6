"""A linear-chain conditional random field over the tokens of texts: each token
is outside, the begin or the inside of a secret.

Tokens are runs of word characters (letters, digits, ``_+-/`` and all
non-ASCII) and runs of other visible characters. A token's score for each tag
adds up weights of its own features (word, shape, length, mix of characters),
of its neighbours' (two to the left, one to the right, apart or touching) and of
its file (sizes and shares). All of a neighbour's part depends on its word
alone, so that the scores of a text are sums of rows of a table of words.

Texts are decoded by Viterbi. Where the score of outside leads by more than any
change of the neighbouring tags could gain, every best path is outside; there
the text is cut, and only the short stretches between such places are decoded."""

from __future__ import annotations

import numpy as np

from treesnap.llm.arrays import _BYTE, _powers, mix

OUTSIDE, BEGIN, INSIDE = range(3)
OWN, LEFT, LEFT_APART, RIGHT, RIGHT_APART, SECOND = range(6)
ROLES = 6
BUCKETS = 1 << 16          # hashed features of each role
FILE = 15                  # file features: three of them in five steps
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FORBIDDEN = -1e9
_CLASS = np.full(256, 2, np.uint8)   # 0 white space, 1 word character, 2 other
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"_+-/", *range(128, 256)]] = 1
_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES < 91), _BYTES + 32, _BYTES).astype(np.uint8)
# small letter, capital, digit, four signs, not ASCII, other
_KIND = np.select([(_BYTES >= 97) & (_BYTES < 123), (_BYTES >= 65) & (_BYTES < 91), (_BYTES >= 48) & (_BYTES < 58), _BYTES == 95, _BYTES == 43, _BYTES == 45, _BYTES == 47, _BYTES >= 128],
                  range(8), 8).astype(np.uint8)
_VOWEL = np.isin(_BYTES, list(b"aeiou"))
_HEXED = np.isin(_BYTES, list(b"0123456789abcdef"))


def tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the tokens of some bytes."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    kind = _CLASS[buf]
    start = np.flatnonzero(np.diff(kind, prepend=np.uint8(255)))
    length = np.diff(np.append(start, len(buf)))
    within = np.arange(len(buf)) - np.repeat(start, length)
    sums = np.add.reduceat(_BYTE[buf] * _powers(int(length.max()))[within], start) + length.astype(np.uint64)
    seen = np.flatnonzero(kind[start])
    return start[seen], start[seen] + length[seen], mix(sums[seen])


def _steps(x: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """How many of the steps each number has reached."""
    return np.searchsorted(np.array(steps), x, side="right").astype(np.uint64)


def _bucket(salt: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), salt, np.uint64)
    for x in parts:
        h = mix(h * _ODD + x.astype(np.uint64))
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of tokens, a row each: for themselves, and as neighbours."""
    length = end - start
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    b = buf[np.repeat(start, length) + within]
    kind, low = _KIND[b], _LOWER[b]
    has = np.bitwise_or.reduceat(np.uint64(1) << kind.astype(np.uint64), first)
    change = np.append(False, kind[1:] != kind[:-1])
    change[first] = False
    turns = _steps(np.add.reduceat(change, first, dtype=np.int64), (1, 2, 3, 5, 9, 16))
    size = _steps(length, (2, 3, 4, 6, 8, 12, 16, 24, 32, 48))
    vowels = _steps(10 * np.add.reduceat(_VOWEL[low], first, dtype=np.int64) // length, (1, 2, 3, 4))
    spread = _steps(np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << (b & 63).astype(np.uint64), first)).astype(np.int64), (3, 6, 9, 12, 16))
    hexed = np.minimum.reduceat(_HEXED[b], first) & (length > 7) & (has == 0b101)   # a small letter and a digit
    word = np.add.reduceat(_BYTE[low] * _powers(int(length.max()))[within], first) + length.astype(np.uint64)
    head = np.zeros((4, len(start)), np.uint64)
    for j in range(4):
        head[j, length > j] = buf[start[length > j] + j]
    punct = _KIND[head[0].astype(np.int64)] == 8
    mixed = np.where(punct, 1 << 9 | head[0] | buf[end - 1].astype(np.uint64) << np.uint64(10), has << np.uint64(4) | size)
    near = [_bucket(1, word), _bucket(2, mixed), _bucket(3, has, turns)]
    own = [*near, _bucket(4, has), _bucket(5, size), _bucket(6, turns, size), _bucket(7, vowels, size), _bucket(8, spread, has),
           _bucket(9, hexed, size), _bucket(10, *head[:3]), _bucket(11, *head, size), _bucket(12, turns, spread)]
    return np.stack(own, axis=1), np.stack(near, axis=1)


EDGE = _bucket(13, np.arange(3))   # the neighbour beyond either end of a text


def file_features(buf: np.ndarray, start: np.ndarray) -> list[int]:
    """Steps of a text's length, of its share of digits and of other visible characters."""
    n = max(1, len(buf))
    digits = int(((buf >= 48) & (buf < 58)).sum()) * 100 // n
    others = int((_CLASS[buf] == 2).sum()) * 100 // n
    steps = ((len(start), (20, 100, 500, 2500)), (digits, (1, 3, 8, 20)), (others, (2, 4, 8, 16)))
    return [5 * i + sum(x >= s for s in edges) for i, (x, edges) in enumerate(steps)]


def _touching(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each token touches the one before it; none touches a text's edge."""
    return np.append(False, start[1:] == end[:-1]) if len(start) else np.zeros(0, bool)


def gather(texts: list[tuple[bytes, list[tuple[int, int]], list[int]]]):
    """Rows of the weights for each token of some short texts (each with a token,
    the byte spans of its secrets and the features of its file), tags, and the
    texts' token counts."""
    glue = ROLES * BUCKETS
    rows, tags, sizes = [], [], []
    for raw, spans, file in texts:
        buf = np.frombuffer(raw, np.uint8)
        start, end, _ = tokens(buf)
        own, near = features(buf, start, end)
        met = _touching(start, end)
        after = np.append(met[1:], False)
        edge = np.tile(EDGE, (2, 1))
        left, second = np.concatenate([edge[:1], near])[:-1], np.concatenate([edge, near])[:-2]
        right = np.concatenate([near[1:], edge[:1]])
        rows.append(np.concatenate([own, left + np.where(met, LEFT, LEFT_APART)[:, None] * BUCKETS, right + np.where(after, RIGHT, RIGHT_APART)[:, None] * BUCKETS,
                                    second + SECOND * BUCKETS, glue + 2 * met[:, None] + after[:, None], np.tile(glue + 4 + np.array(file), (len(own), 1))], axis=1))
        tag = np.zeros(len(start), np.int64)
        for s, e in spans:
            inside = np.flatnonzero((start < e) & (end > s))
            tag[inside] = INSIDE
            tag[inside[:1]] = BEGIN
        tags.append(tag)
        sizes.append(len(start))
    if not rows:
        return np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(tags), np.array(sizes, np.int64)


def fit(texts: list[tuple[bytes, list[tuple[int, int]], list[int]]], rounds: int = 30, rate: float = 0.3, decay: float = 2e-6, parts: int = 8) -> dict:
    """Weights by gradient steps on the likelihood of the tags, the same for the
    same texts in the same order."""
    texts = [t for t in texts if t[0].split()]
    ids, tags, sizes = gather(texts)
    weights, moves = np.zeros((ROLES * BUCKETS + 4 + FILE, 3), np.float64), np.zeros((3, 3))
    barred = np.zeros((3, 3), bool)
    barred[OUTSIDE, INSIDE] = True
    if not len(ids):
        return {"weights": weights.astype(np.float32), "moves": np.where(barred, _FORBIDDEN, moves)}
    begin = np.cumsum(sizes) - sizes
    past, past_moves = np.full(weights.shape, 1e-6), np.full((3, 3), 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(sizes)), min(parts, len(sizes))):
            own = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[part], sizes[part], strict=True)])
            n, longest = sizes[part], int(sizes[part].max())
            at = np.arange(longest)[None] < n[:, None]
            scores = np.zeros((len(part), longest, 3))
            scores[..., 1:] = -30   # beyond the end: outside
            scores[at] = weights[ids[own]].sum(axis=1)
            gold = np.zeros((len(part), longest), np.int64)
            gold[at] = tags[own]
            share, pairs = _marginals(scores, np.where(barred, _FORBIDDEN, moves))
            error = (share - np.eye(3)[gold])[at]
            flat = ids[own].ravel()
            used, inverse = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(inverse, np.repeat(error[:, y], ids.shape[1]), len(used)) for y in range(3)], axis=1)
            step = step / len(part) + decay * weights[used]
            past[used] += step ** 2
            weights[used] -= rate * step / np.sqrt(past[used])
            whole = np.pad(gold, ((0, 0), (1, 1)))
            seen = np.zeros((3, 3))
            np.add.at(seen, (whole[:, :-1].ravel(), whole[:, 1:].ravel()), 1)
            turn = (pairs - seen) / len(part) + decay * moves
            past_moves += turn ** 2
            moves -= rate * turn / np.sqrt(past_moves)
    return {"weights": weights.astype(np.float32), "moves": np.where(barred, _FORBIDDEN, moves)}


def _marginals(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each tag at each place, and expected moves over all rows,
    with an outside before and after each row."""
    n, longest, _ = scores.shape
    go, here = np.exp(moves), np.exp(scores - scores.max(axis=2, keepdims=True))
    on, back, scale = np.zeros((longest, n, 3)), np.ones((longest, n, 3)), np.zeros((longest, n, 1))
    state = np.tile(np.eye(3)[OUTSIDE], (n, 1))
    for i in range(longest):
        state = (state @ go) * here[:, i]
        scale[i] = state.sum(axis=1, keepdims=True)
        state = on[i] = state / scale[i]
    back[-1] = go[:, OUTSIDE]
    for i in range(longest - 2, -1, -1):
        back[i] = ((back[i + 1] * here[:, i + 1]) @ go.T) / scale[i + 1]
    total = (on * back).sum(axis=2, keepdims=True)
    share = on * back / total
    pairs = np.zeros((3, 3))
    for i in range(longest - 1):
        both = on[i][:, :, None] * go * (back[i + 1] * here[:, i + 1] / scale[i + 1])[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    pairs[OUTSIDE] += share[0].sum(axis=0)
    pairs[:, OUTSIDE] += share[-1].sum(axis=0)
    return share.transpose(1, 0, 2), pairs


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of one sequence between two outside ones; of equally good ones
    the first tag at the last place where they differ."""
    n = len(scores)
    best, came = moves[OUTSIDE] + scores[0], np.zeros((n, 3), np.int64)
    for i in range(1, n):
        ways = best[:, None] + moves
        came[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[i]
    tag = int((best + moves[:, OUTSIDE]).argmax())
    out = np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        out[i] = tag
        tag = came[i, tag]
    return out


def decode(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best tags of texts that follow each other, of which ``first`` marks the
    first tokens: by Viterbi over the stretches in which not every place is
    sure to be outside."""
    lead = np.full(len(scores), np.inf)
    ahead = np.append(scores[1:, INSIDE] - scores[1:, BEGIN], -np.inf)
    ahead[np.flatnonzero(first[1:])] = -np.inf   # the next token is another text's
    for y in (BEGIN, INSIDE):
        before = max(moves[p, y] - moves[p, OUTSIDE] for p in range(3) if moves[p, y] > _FORBIDDEN / 2)
        plain = max(moves[y, n] - moves[OUTSIDE, n] for n in (OUTSIDE, BEGIN))
        # a following inside would have to become a begin
        shifted = moves[y, INSIDE] - moves[OUTSIDE, BEGIN] + max(moves[INSIDE, m] - moves[BEGIN, m] for m in range(3)) + ahead
        lead = np.minimum(lead, scores[:, OUTSIDE] - scores[:, y] - before - np.maximum(plain, shifted))
    open_at = lead <= 1e-6
    out = np.zeros(len(scores), np.int64)
    at = np.flatnonzero(open_at)
    if len(at):
        new = np.flatnonzero((np.diff(at, prepend=-2) > 1) | first[at])
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
            part = at[lo:hi]
            out[part] = viterbi(scores[part], moves)
    return out


class Tagger:
    """Decodes texts with given weights."""

    def __init__(self, model: dict):
        self.weights, self.moves = model["weights"], model["moves"]
        glue = ROLES * BUCKETS
        self.glue, self.file = self.weights[glue:glue + 4], self.weights[glue + 4:]
        self.edge = [None, *[self.weights[r * BUCKETS + EDGE].sum(axis=0) for r in range(1, ROLES)]]

    def _rows(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Scores of each token's word by role and tag; equal words count once."""
        _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        own, near = features(buf, start[first], end[first])
        table = np.empty((len(first), ROLES, 3), np.float32)
        for r in range(ROLES):
            ids = own if r == OWN else near + r * BUCKETS
            table[:, r] = sum(self.weights[ids[:, j]] for j in range(ids.shape[1]))
        return table[place]

    def __call__(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """Byte spans of the secrets of each text."""
        raw = b"\n".join(texts)
        begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.zeros(0, np.int64)
        buf = np.frombuffer(raw, np.uint8)
        start, end, hashes = tokens(buf)
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not len(start):
            return found
        text = np.searchsorted(begin, start, side="right") - 1
        rows = self._rows(buf, start, end, hashes)
        first = np.diff(text, prepend=-1) > 0
        last = np.append(first[1:], True)
        met = _touching(start, end)
        after = np.append(met[1:], False)
        scores = rows[:, OWN] + self.glue[2 * met + after]
        role = np.where(met, LEFT, LEFT_APART)[1:]
        scores[1:] += np.where(first[1:, None], self.edge[LEFT_APART], rows[np.arange(len(rows) - 1), role])
        scores[0] += self.edge[LEFT_APART]
        role = np.where(after, RIGHT, RIGHT_APART)[:-1]
        scores[:-1] += np.where(last[:-1, None], self.edge[RIGHT_APART], rows[np.arange(1, len(rows)), role])
        scores[-1] += self.edge[RIGHT_APART]
        near_edge = first.copy()
        near_edge[1:] |= first[:-1]
        second = np.concatenate([np.zeros((2, 3), np.float32), rows[:-2, SECOND]])[:len(rows)]
        scores += np.where(near_edge[:, None], self.edge[SECOND], second)
        edges = np.append(begin, len(buf) + 1)
        cut = np.searchsorted(start, edges)
        wide = np.array([self.file[file_features(buf[lo:hi - 1], start[a:b])].sum(axis=0) for lo, hi, a, b in zip(edges[:-1], edges[1:], cut[:-1], cut[1:])])
        scores = (scores + wide[text]).astype(np.float64)
        tags = decode(scores, self.moves, first)
        for i in np.flatnonzero(tags == BEGIN).tolist():
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE:
                j += 1
            found[text[i]].append((int(start[i] - begin[text[i]]), int(end[j - 1] - begin[text[i]])))
        return found
