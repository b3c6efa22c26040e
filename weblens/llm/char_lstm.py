"""A bidirectional LSTM over characters with CRF transitions, in numpy.

Characters are folded to a small alphabet (digits are one symbol, case and class are a
second feature); both directions run in one loop over a batch of windows. The output of a
position is a score for each tag: 0 for outside, 2k + 1 and 2k + 2 for the first and a
later character of a span of kind k. The CRF adds a score for each pair of tags; a later
character follows only its own kind. Training maximises the likelihood of the labelled
tags by Adam; decoding takes the best tag sequence of each window and its marginals.
"""

import numpy as np

HIDDEN = 20
BATCH = 64
EPOCHS = 14
RATE = 0.02
_NEVER = -1e4

#: The alphabet: padding, other letters, other characters, ASCII by folded character.
_PAD, _LETTER, _OTHER, _FIRST = 0, 1, 2, 3
_ASCII = np.arange(128)
_FOLDED = np.array([_FIRST + (48 if chr(i).isdigit() else ord(chr(i).lower())) for i in range(128)], np.int16)
SYMBOLS = _FIRST + 128
#: A second feature: padding, small letter, capital, digit, blank, mark, other.
_CLASS = np.array([4 if chr(i).isspace() else 3 if chr(i).isdigit() else 2 if chr(i).isupper() else 1 if chr(i).islower() else 5 for i in range(128)], np.int16)
CLASSES = 7


def codes(windows: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, classes) of windows of at most ``width`` characters, padded at the end."""
    symbols, classes = np.zeros((len(windows), width), np.int16), np.zeros((len(windows), width), np.int16)
    for row, text in enumerate(windows):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        plain = points < 128
        low = np.where(plain, points, 0)
        letters = np.array([c.isalpha() for c in text]) if not plain.all() else plain
        symbols[row, : len(points)] = np.where(plain, _FOLDED[low], np.where(letters, _LETTER, _OTHER))
        classes[row, : len(points)] = np.where(plain, _CLASS[low], np.where(letters, 1, 6))
    return symbols, classes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Parameters and passes of the network for ``kinds`` kinds of spans."""

    def __init__(self, kinds: int, hidden: int = HIDDEN, seed: int = 5):
        draw, f = np.random.default_rng(seed), np.float32
        self.kinds, self.hidden, self.tags = kinds, hidden, 2 * kinds + 1
        self.symbol = draw.normal(0, 0.3, (2, SYMBOLS, 4 * hidden)).astype(f)
        self.kind = draw.normal(0, 0.3, (2, CLASSES, 4 * hidden)).astype(f)
        self.kind[:, :, hidden : 2 * hidden] += 0.5  # remember at first
        self.back = draw.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)).astype(f)
        self.out = draw.normal(0, (2 * hidden) ** -0.5, (2 * hidden, self.tags)).astype(f)
        self.offset = np.zeros(self.tags, f)
        self.trans = np.zeros((self.tags, self.tags), f)
        self.start = np.zeros(self.tags, f)
        later = np.arange(2, self.tags, 2)
        self.banned = np.zeros((self.tags, self.tags), bool)
        self.banned[:, later] = True
        self.banned[later, later] = self.banned[later - 1, later] = False
        self.late = later

    def parameters(self) -> list[np.ndarray]:
        return [self.symbol, self.kind, self.back, self.out, self.offset, self.trans, self.start]

    def pairs(self) -> np.ndarray:
        return np.where(self.banned, _NEVER, self.trans)

    def opening(self) -> np.ndarray:
        opening = self.start.copy()
        opening[self.late] = _NEVER
        return opening

    # -- the two directions ------------------------------------------------

    def states(self, symbols: np.ndarray, classes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (window, position, 2 * hidden)."""
        n, width = symbols.shape
        h = np.zeros((2, n, self.hidden), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((n, width, 2 * self.hidden), np.float32)
        m = self.hidden
        for t in range(width):
            at = (t, width - 1 - t)
            z = h @ self.back
            for d in (0, 1):
                z[d] += self.symbol[d, symbols[:, at[d]]]
                z[d] += self.kind[d, classes[:, at[d]]]
            gates = _sigmoid(z[:, :, : 3 * m])
            new = np.tanh(z[:, :, 3 * m :])
            before, c = c, gates[:, :, m : 2 * m] * c + gates[:, :, :m] * new
            wide = np.tanh(c)
            if keep is not None:
                keep.append((h, before, gates, new, wide))
            h = gates[:, :, 2 * m :] * wide
            out[:, at[0], :m], out[:, at[1], m:] = h[0], h[1]
        return out

    def _backward(self, symbols, classes, kept, grad):
        """Gradients of symbol, kind and back, given those of the states."""
        m, width = self.hidden, symbols.shape[1]
        g_symbol, g_kind, g_back = np.zeros_like(self.symbol), np.zeros_like(self.kind), np.zeros_like(self.back)
        dh = np.zeros((2, len(symbols), m), np.float32)
        dc = np.zeros_like(dh)
        for t in reversed(range(width)):
            at = (t, width - 1 - t)
            h, before, gates, new, wide = kept[t]
            dh = dh + np.stack([grad[:, at[0], :m], grad[:, at[1], m:]])
            i, f, o = gates[:, :, :m], gates[:, :, m : 2 * m], gates[:, :, 2 * m :]
            dc = dc + dh * o * (1 - wide**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * wide * o * (1 - o), dc * i * (1 - new**2)], axis=2)
            g_back += h.transpose(0, 2, 1) @ dz
            for d in (0, 1):
                for into, index, size in ((g_symbol, symbols, SYMBOLS), (g_kind, classes, CLASSES)):
                    hot = np.zeros((size, len(symbols)), np.float32)
                    hot[index[:, at[d]], np.arange(len(symbols))] = 1
                    into[d] += hot @ dz[d]
            dh = dz @ self.back.transpose(0, 2, 1)
            dc = dc * f
        return g_symbol, g_kind, g_back

    def emissions(self, symbols: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return (self.states(symbols, classes) @ self.out + self.offset).astype(np.float64)

    # -- the CRF -----------------------------------------------------------

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tag marginals, sum of pair marginals, log of the normaliser)."""
        n, width, tags = e.shape
        move = np.exp(self.pairs().astype(np.float64))
        ahead, behind = np.zeros_like(e), np.zeros_like(e)

        def spread(x: np.ndarray, by: np.ndarray) -> np.ndarray:
            top = x.max(axis=1, keepdims=True)
            return top + np.log(np.exp(x - top) @ by + 1e-300)

        ahead[:, 0] = self.opening() + e[:, 0]
        for t in range(1, width):
            ahead[:, t] = spread(ahead[:, t - 1], move) + e[:, t]
        for t in range(width - 2, -1, -1):
            behind[:, t] = spread(behind[:, t + 1] + e[:, t + 1], move.T)
        top = ahead[:, -1].max(axis=1)
        norm = top + np.log(np.exp(ahead[:, -1] - top[:, None]).sum(axis=1))
        single = np.exp(ahead + behind - norm[:, None, None])
        left = np.exp(ahead[:, :-1] - ahead[:, :-1].max(axis=2, keepdims=True))
        right = behind[:, 1:] + e[:, 1:]
        right = np.exp(right - right.max(axis=2, keepdims=True))
        weight = np.einsum("nti,ij,ntj->nt", left, move, right)
        pair = np.einsum("nti,ntj->ij", left / weight[:, :, None], right) * move
        return single, pair, norm

    def best(self, e: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        n, width, tags = e.shape
        pairs, back = self.pairs().astype(np.float64), np.zeros((width, n, tags), np.int8)
        score = self.opening() + e[:, 0]
        for t in range(1, width):
            options = score[:, :, None] + pairs[None]
            back[t] = options.argmax(axis=1)
            score = options.max(axis=1) + e[:, t]
        path = np.zeros((n, width), np.int8)
        path[:, -1] = score.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            path[:, t - 1] = back[t, np.arange(n), path[:, t]]
        return path

    def spans(self, windows: list[str], width: int, batch: int = 256) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, least marginal of its tags) of every span in each window."""
        out: list[list[tuple[int, int, int, float]]] = []
        for first in range(0, len(windows), batch):
            some = windows[first : first + batch]
            e = self.emissions(*codes(some, width))
            path, single = self.best(e), self.marginals(e)[0]
            sure = np.take_along_axis(single, path[:, :, None].astype(np.int64), 2)[:, :, 0]
            for row, text in enumerate(some):
                found, tags = [], path[row]
                for at in np.flatnonzero(tags % 2 == 1):
                    end = at + 1
                    while end < width and tags[end] == tags[at] + 1:
                        end += 1
                    if end <= len(text):
                        found.append((int(tags[at]) // 2, int(at), int(end), float(sure[row, at:end].min())))
                out.append(found)
        return out


def train(windows: list[str], tags: list[np.ndarray], kinds: int, width: int, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 5) -> Tagger:
    """Fit a tagger to windows and their tags, one number a character."""
    net, draw = Tagger(kinds, hidden, seed), np.random.default_rng(seed)
    if not windows:
        net.offset[0] = 20  # nothing is known: everything is outside
        return net
    symbols, classes = codes(windows, width)
    truth = np.zeros(symbols.shape, np.int64)
    for row, t in enumerate(tags):
        truth[row, : len(t)] = t
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    turn, total = 0, epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            s, c, y = symbols[some], classes[some], truth[some]
            kept: list = []
            states = net.states(s, c, kept)
            e = (states @ net.out + net.offset).astype(np.float64)
            single, pair, _ = net.marginals(e)
            np.put_along_axis(single, y[:, :, None], np.take_along_axis(single, y[:, :, None], 2) - 1, 2)
            d_e = (single / len(some)).astype(np.float32)
            np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            d_trans = np.where(net.banned, 0, pair / len(some)).astype(np.float32)
            d_start = d_e[:, 0].sum(axis=0)
            d_start[net.late] = 0
            grads = net._backward(s, c, kept, d_e @ net.out.T)
            grads = [*grads, states.reshape(-1, states.shape[2]).T @ d_e.reshape(-1, net.tags), d_e.sum(axis=(0, 1)), d_trans, d_start]
            size = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
            grads = [g * min(1.0, 5.0 / max(size, 1e-9)) for g in grads]
            turn += 1
            rate = RATE * (1 - 0.9 * turn / total)
            for value, g, m, v in zip(net.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return net
