"""Small vectorised NumPy helpers that run inside Spark tasks: one row of a matrix is one window of one channel."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Decomposition low-pass filter of the Daubechies wavelet with 4 vanishing moments.
DB4 = np.array([
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
])


# ---- filter design: second-order sections, rows (b0, b1, b2, a1, a2) with the gain apart -------------------------


def _prototype(order: int) -> np.ndarray:
    return -np.exp(1j * np.pi * np.arange(1 - order, order, 2) / (2 * order))


def _pairs(poles: np.ndarray) -> list[np.ndarray]:
    """Denominators: one per conjugate pair, real poles two by two."""
    upper = poles[poles.imag > 1e-9]
    real = np.sort(poles[np.abs(poles.imag) <= 1e-9].real)
    out = [np.array([-2 * p.real, abs(p) ** 2]) for p in upper[np.argsort(np.abs(upper))]]
    for i in range(0, len(real) - 1, 2):
        out.append(np.array([-(real[i] + real[i + 1]), real[i] * real[i + 1]]))
    if len(real) % 2:
        out.append(np.array([-real[-1], 0.0]))
    return out


def _warped(f: float, fs: float) -> float:
    if not 0 < f < fs / 2:
        raise ValueError(f"{f} Hz lies outside 0 to half of {fs} Hz")
    return 4 * np.tan(np.pi * f / fs)


def _bilinear(s: np.ndarray) -> np.ndarray:
    return (4 + s) / (4 - s)


@lru_cache(256)
def butterworth(kind: str, order: int, low: float, high: float, fs: float) -> tuple[np.ndarray, float]:
    """Sections and gain of a ``bandpass``, ``bandstop`` or ``lowpass`` (cut-off ``high``) Butterworth filter."""
    p = _prototype(order)
    if kind == "lowpass":
        s = p * _warped(high, fs)
        gain = _warped(high, fs) ** order / np.prod(4 - s)
        heads = [np.array([1.0, 2, 1])] * (order // 2) + [np.array([1.0, 1, 0])] * (order % 2)
    else:
        one, two = _warped(low, fs), _warped(high, fs)
        width, centre = two - one, np.sqrt(one * two)
        q = p * width / 2 if kind == "bandpass" else width / 2 / p
        root = np.sqrt(q**2 - centre**2 + 0j)
        s = np.concatenate([q + root, q - root])
        if kind == "bandpass":
            gain = (4 * width) ** order / np.prod(4 - s)
            heads = [np.array([1.0, 0, -1])] * order
        else:
            gain = (16 + centre**2) ** order / np.prod(4 - s)
            z = _bilinear(np.array([1j * centre]))[0]
            heads = [np.array([1.0, -2 * z.real, 1])] * order
    tails = _pairs(_bilinear(s))
    return np.array([np.concatenate([b, a]) for b, a in zip(heads, tails, strict=True)]), float(np.real(gain))


@lru_cache(64)
def notch_section(f0: float, q: float, fs: float) -> tuple[np.ndarray, float]:
    w = 2 * np.pi * f0 / fs
    g = 1 / (1 + np.tan(w / (2 * q)))
    return np.array([[1, -2 * np.cos(w), 1, -2 * g * np.cos(w), 2 * g - 1]]), g


def lowpass_order(fp: float, fst: float, gpass: float, gstop: float, fs: float) -> tuple[int, float]:
    """Least order and cut-off frequency for the given pass and stop edges (Hz) and losses (dB)."""
    one, two = np.tan(np.pi * fp / fs), np.tan(np.pi * fst / fs)
    a, b = 10 ** (gpass / 10) - 1, 10 ** (gstop / 10) - 1
    order = int(np.ceil(np.log10(b / a) / (2 * np.log10(two / one))))
    return order, fs / np.pi * np.arctan(one * a ** (-1 / (2 * order)))


def frequency_response(sections: np.ndarray, gain: float, f: np.ndarray, fs: float) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.asarray(f, float) / fs)
    h = np.full(z.shape, gain, complex)
    for b0, b1, b2, a1, a2 in sections:
        h *= (b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2)
    return h


# ---- running filters ---------------------------------------------------------------------------------------------


def steady_state(sections: np.ndarray, gain: float) -> np.ndarray:
    """State of each section after an endless input of 1: sections x 2."""
    level, out = gain, []
    for b0, b1, b2, a1, a2 in sections:
        y = level * (b0 + b1 + b2) / (1 + a1 + a2)
        second = b2 * level - a2 * y
        out.append((b1 * level - a1 * y + second, second))
        level = y
    return np.array(out)


def run_sections(sections: np.ndarray, gain: float, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter the rows of ``x`` from ``state`` (sections x 2 x rows); the end state comes back too."""
    y, state = x.T * gain, state.copy()
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        s1, s2 = state[k]
        out = np.empty_like(y)
        for t in range(len(y)):
            v = y[t]
            w = b0 * v + s1
            s1 = b1 * v - a1 * w + s2
            s2 = b2 * v - a2 * w
            out[t] = w
        state[k] = s1, s2
        y = out
    return y.T, state


def zero_phase(sections: np.ndarray, gain: float, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward, with odd extension by ``pad`` samples and steady-state starts."""
    n = x.shape[1]
    if n <= pad:
        raise ValueError(f"{n} samples are too few: more than {pad} are needed")
    x = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], 1)
    start = steady_state(sections, gain)[:, :, None]
    for _ in range(2):
        x, _ = run_sections(sections, gain, x, start * x[:, 0])
        x = x[:, ::-1]
    return x[:, pad : pad + n]


#: Kinds of filter that the operators name: (sections, gain, padding).
def named_filter(kind: str, fs: float, low: float = 0.2, high: float = 50.0, order: int = 4, q: float = 30.0) -> tuple[np.ndarray, float, int]:
    fs = round(float(fs), 6)
    if kind == "notch":
        return *notch_section(low, q, fs), 9
    sections, gain = butterworth(kind, order, low, high, fs)
    return sections, gain, 3 * (order * (1 if kind == "lowpass" else 2) + 1)


def window_operator(kind: str, n: int, fs: float, low: float, high: float, order: int, q: float) -> np.ndarray:
    """The zero-phase filter of windows of ``n`` samples as a matrix: all rows of a batch are filtered by one product."""
    sections, gain, pad = named_filter(kind, fs, low, high, order, q)
    return zero_phase(sections, gain, np.eye(n), pad)


class Operators:
    """The matrices of filters and lengths that have met enough rows to be worth it, in ``limit`` bytes, and the rows of the
    others so far."""

    def __init__(self, limit: int = 64 << 20):
        self.limit, self.bytes = limit, 0
        self.kept: dict[tuple, np.ndarray] = {}
        self.rows: dict[tuple, int] = {}

    def get(self, key: tuple, rows: int) -> np.ndarray | None:
        """The matrix, if there is one by now. Its making is as much work as filtering as many rows as it has."""
        n = key[1]
        if key in self.kept:
            self.kept[key] = self.kept.pop(key)  # the last one used goes last
            return self.kept[key]
        self.rows[key] = self.rows.get(key, 0) + rows
        if self.rows[key] < n or 8 * n * n > self.limit // 4:
            if len(self.rows) > 4096:
                self.rows.clear()
            return None
        del self.rows[key]
        made = window_operator(*key)
        while self.kept and self.bytes + made.nbytes > self.limit:
            self.bytes -= self.kept.pop(next(iter(self.kept))).nbytes
        self.kept[key], self.bytes = made, self.bytes + made.nbytes
        return made


OPERATORS = Operators()


def filter_rows(x: np.ndarray, kind: str, fs: float, low: float = 0.2, high: float = 50.0, order: int = 4, q: float = 30.0) -> np.ndarray | None:
    """Zero-phase filter of each row; None where rows are too short or the band doesn't fit the rate. NaN stays in its row."""
    fs = round(float(fs), 6)
    n = x.shape[1]
    try:
        sections, gain, pad = named_filter(kind, fs, low, high, order, q)
        if n <= pad:
            return None
        matrix = OPERATORS.get((kind, n, fs, low, high, order, q), len(x))
        return zero_phase(sections, gain, x, pad) if matrix is None else x @ matrix
    except ValueError:
        return None


@lru_cache(16)
def trailing_weights(n: int, fs: float, low: float = 1.0, high: float = 50.0, order: int = 5, f0: float = 50.0, q: float = 30.0) -> np.ndarray:
    """Weights of a window of ``n`` samples whose product with it is the last value after notch and band-pass."""
    notch = window_operator("notch", n, fs, f0, 0.0, 0, q)
    return (notch @ window_operator("bandpass", n, fs, low, high, order, q))[:, -1].copy()


# ---- long signals in blocks --------------------------------------------------------------------------------------


def block_responses(sections: np.ndarray, gain: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and end states of each row filtered from a zero state."""
    return run_sections(sections, gain, x, np.zeros((len(sections), 2, x.shape[0])))


@lru_cache(64)
def _transition(key: tuple, length: int) -> tuple[np.ndarray, np.ndarray]:
    sections = np.array(key).reshape(-1, 5)
    m = 2 * len(sections)
    unit = np.zeros((len(sections), 2, m))
    unit.reshape(m, m)[...] = np.eye(m)
    y, state = run_sections(sections, 1.0, np.zeros((m, length)), unit)
    return state.reshape(m, m), y


def chain_blocks(sections: np.ndarray, ends: np.ndarray, start: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """State at the start of every block from the zero-state end states (blocks x 2*sections), the blocks' lengths and the
    first state."""
    key = tuple(sections.ravel())
    out, state = np.empty_like(ends), start
    for b, n in enumerate(np.broadcast_to(lengths, len(ends))):
        out[b] = state
        state = _transition(key, int(n))[0] @ state + ends[b]
    return out


def add_state(sections: np.ndarray, y: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Add what the blocks' start states put on their zero-state outputs."""
    _, response = _transition(tuple(sections.ravel()), y.shape[1])
    return y + states @ response


# ---- spectra -----------------------------------------------------------------------------------------------------


def welch(x: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: periodic Hann, half overlap, segment means removed, mean over segments."""
    n = min(nperseg, x.shape[1])
    hop = n - n // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segments = np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, ::hop]
    segments = (segments - segments.mean(-1, keepdims=True)) * window
    p = np.abs(np.fft.rfft(segments, axis=-1)) ** 2 / (fs * (window**2).sum())
    p[..., 1 : (n + 1) // 2] *= 2
    return np.arange(n // 2 + 1) * fs / n, p.mean(1)


def fft_power(x: np.ndarray, fs: float, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two-sided ``|FFT|^2 / size`` of rows filled up with zeros to a power of two."""
    size = size or 1 << max(0, int(np.ceil(np.log2(max(1, x.shape[1])))))
    return np.arange(size) * fs / size, np.abs(np.fft.fft(x, size, axis=1)) ** 2 / size


def envelope(x: np.ndarray) -> np.ndarray:
    """Size of the analytic signal of each row."""
    n = x.shape[1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x, axis=1) * weight, axis=1))


# ---- wavelet reference and adaptive cancelling -------------------------------------------------------------------

_REC_LOW = DB4[::-1]
_DEC_HIGH = _REC_LOW * (-1.0) ** (np.arange(8) + 1)
_REC_HIGH = _DEC_HIGH[::-1]


def _convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    n = x.shape[1] + len(taps) - 1
    out = np.zeros((x.shape[0], n))
    for k, c in enumerate(taps):
        out[:, k : k + x.shape[1]] += c * x
    return out


def dwt(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: approximation and detail, with half-sample symmetric extension."""
    n = x.shape[1]
    at = np.arange(-7, n + 7) % (2 * n)
    x = x[:, np.where(at < n, at, 2 * n - 1 - at)]
    keep = slice(8, 8 + 2 * ((n + 7) // 2) - 1, 2)
    return _convolved(x, DB4)[:, keep], _convolved(x, _DEC_HIGH)[:, keep]


def idwt(approximation: np.ndarray, detail: np.ndarray) -> np.ndarray:
    approximation = approximation[:, : detail.shape[1]]
    spread = lambda c: np.stack([c, np.zeros_like(c)], 2).reshape(len(c), -1)[:, :-1]
    y = _convolved(spread(approximation), _REC_LOW) + _convolved(spread(detail), _REC_HIGH)
    return y[:, 6:-6]


def wavelet_reference(x: np.ndarray, level: int = 7, soften: tuple[int, ...] = (1, 2, 3, 4)) -> np.ndarray:
    """Each row rebuilt after soft thresholding of the detail bands in ``soften``, counted from the coarsest."""
    details, low = [], x
    for _ in range(level):
        low, d = dwt(low)
        details.append(d)
    for i, d in enumerate(reversed(details), 1):
        if i in soften:
            spread = np.median(np.abs(d - np.median(d, axis=1, keepdims=True)), axis=1, keepdims=True) / 0.6745
            d = np.sign(d) * np.maximum(np.abs(d) - spread * np.sqrt(2 * np.log(x.shape[1])), 0)
        low = idwt(low, d)
    return low[:, : x.shape[1]]


def rls_cancel(x: np.ndarray, reference: np.ndarray, forget: float = 0.98, p0: float = 1e4) -> tuple[np.ndarray, np.ndarray]:
    """Error and weight of a one-tap recursive least squares canceller, by its two discounted sums.

    The weight before sample k is the discounted sum of ``reference * x`` over that of ``reference ** 2`` up to
    k - 1; both start from ``1 / p0``, so that the first weight is 1.
    """
    square = np.full(x.shape[0], 1 / p0)
    cross = square.copy()
    error, weight = np.empty_like(x), np.empty_like(x)
    for k in range(x.shape[1]):
        r = reference[:, k]
        weight[:, k] = cross / square
        error[:, k] = x[:, k] - weight[:, k] * r
        square = forget * square + r * r
        cross = forget * cross + r * x[:, k]
    return error, weight


def waaf(x: np.ndarray, level: int = 7, soften: tuple[int, ...] = (1, 2, 3, 4), forget: float = 0.98, p0: float = 1e4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cleaned rows, references and weights of the wavelet-assisted adaptive filter."""
    reference = wavelet_reference(x, level, soften)
    return (*((r := rls_cancel(x, reference, forget, p0))[:1]), reference, r[1])


def kalman_gains(n: int, q: float = 0.5, r: float = 0.5, p0: float = 1000.0) -> np.ndarray:
    """Gains of the scalar random-walk filter: they don't depend on the data."""
    out, p = np.empty(n), p0
    for k in range(n):
        p += q
        out[k] = p / (p + r)
        p *= 1 - out[k]
    return out


def kalman_memory(q: float = 0.5, r: float = 0.5, p0: float = 1000.0, small: float = 1e-17) -> tuple[float, int]:
    """The settled gain, and the number of samples after which gain and value have forgotten how they began."""
    settled = (-q + np.sqrt(q * q + 4 * q * r)) / 2  # variance after an update, at rest
    gain = (settled + q) / (settled + q + r)
    if gain <= 0:
        raise ValueError("a filter without noise in its state never forgets: q must be above 0")
    if gain >= 1:
        return 1.0, 1
    fade = int(np.ceil(np.log(small) / np.log1p(-gain)))
    return float(gain), fade + 1


def kalman(z: np.ndarray, q: float = 0.5, r: float = 0.5, p0: float = 1000.0) -> np.ndarray:
    gains, x, out = kalman_gains(z.shape[1], q, r, p0), np.zeros(z.shape[0]), np.empty_like(z)
    for k, g in enumerate(gains):
        x = x + g * (z[:, k] - x)
        out[:, k] = x
    return out
