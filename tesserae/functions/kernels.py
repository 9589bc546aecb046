"""NumPy kernels for what no aggregate expresses: filters, transforms, entropies, fits.

All take rows of equal length side by side where they can; the operators around them deal rows to tasks.
"""

from __future__ import annotations

import math

import numpy as np

from tesserae.functions import nearest


def erf(x: np.ndarray) -> np.ndarray:
    """The error function: its power series within 3, the continued fraction of its complement beyond."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(np.nan_to_num(x)), 30.0)
    near = np.minimum(a, 3.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 80):
        term = term * -(near**2) / n
        total = total + term / (2 * n + 1)
    far, f = np.maximum(a, 3.0), np.zeros_like(a)
    for k in range(60, 0, -1):
        f = k / 2 / (far + f)
    tail = np.exp(-(far**2)) / (math.sqrt(math.pi) * (far + f))
    return np.where(np.isnan(x), np.nan, np.sign(x) * np.where(a <= 3, 2 / math.sqrt(math.pi) * total, 1 - tail))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive values: Stirling's series from 14 on, the recurrence below."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(14):
        low = x < 14
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    r = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + r / 12 - r**3 / 360 + r**5 / 1260 - r**7 / 1680 - shift


def butterworth(order: int, low: float | None, high: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a1, a2) of a band-pass, or low-pass (low None), for frequencies relative to Nyquist; even orders."""
    poles = -np.exp(1j * np.pi * np.arange(-order + 1, order, 2) / (2 * order))
    warp = lambda f: 4 * np.tan(np.pi * f / 2)
    if low is None:
        w = warp(high)
        poles, gain, zeros = poles * w, w**order, 0
    else:
        w1, w2 = warp(low), warp(high)
        half, centre = poles * (w2 - w1) / 2, w1 * w2
        root = np.sqrt(half**2 - centre)
        poles, gain, zeros = np.concatenate([half + root, half - root]), (w2 - w1) ** order, order
    gain = gain * np.real(4.0**zeros / np.prod(4 - poles))
    poles = (4 + poles) / (4 - poles)
    upper = sorted(poles[poles.imag > 0], key=lambda p: abs(p))
    b = (1.0, 2.0, 1.0) if low is None else (1.0, 0.0, -1.0)
    sections = np.array([[*b, -2 * p.real, abs(p) ** 2] for p in upper])
    sections[0, :3] *= gain
    return sections


def run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filters rows, begun in the steady state of each row's first value."""
    x, level = x.copy(), x[:, 0].copy()
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1 = (b2 - a2 * gain) * level
        z0 = (b1 - a1 * gain) * level + z1
        for t in range(x.shape[1]):
            v = x[:, t]
            y = b0 * v + z0
            z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
            x[:, t] = y
        level = level * gain
    return x


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over rows continued oddly by three times the filter's length; rows with a gap become missing."""
    n = 3 * (2 * len(sections) + 1)
    if x.shape[1] <= n:
        return np.full_like(x, np.nan)
    wide = np.concatenate([2 * x[:, :1] - x[:, n:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]], 1)
    return run_sections(sections, run_sections(sections, wide)[:, ::-1])[:, ::-1][:, n:-n]


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of rows by the one-sided spectrum."""
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)


def morlet_phase(x: np.ndarray, period: float, w0: float = 6.0) -> np.ndarray:
    """Phase at one period (in samples) by a Morlet wavelet; missing inside the cone of influence."""
    n = x.shape[1]
    scale = period * (w0 + math.sqrt(2 + w0 * w0)) / (4 * math.pi)
    w = 2 * np.pi * np.fft.fftfreq(n)
    psi = np.where(w > 0, np.pi**-0.25 * np.exp(-0.5 * (scale * w - w0) ** 2), 0) * math.sqrt(2 * np.pi * scale)
    phase = np.angle(np.fft.ifft(np.fft.fft(x - x.mean(1, keepdims=True), axis=1) * psi, axis=1))
    edge = int(math.ceil(math.sqrt(2) * scale))
    phase[:, :edge] = np.nan
    phase[:, n - edge if edge else n :] = np.nan
    return phase


def welch(x: np.ndarray, segment: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and area-normalised power of one series: Hann windows half overlapping, each detrended."""
    n = min(segment, len(x))
    step, t = max(1, n - n // 2), np.arange(n)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / n)
    parts = []
    for s in range(0, len(x) - n + 1, step):
        y = x[s : s + n]
        y = y - np.polyval(np.polyfit(t, y, 1), t)
        parts.append(np.abs(np.fft.rfft(y * hann)) ** 2)
    f, p = np.fft.rfftfreq(n), np.mean(parts, 0)
    p[1 : -1 if n % 2 == 0 else None] *= 2
    area = np.trapezoid(p, f)
    return f, p / area if area > 0 else p


def surrogate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series of the same spectrum with random phases; mean and Nyquist stay real."""
    spectrum = np.fft.rfft(x)
    turn = np.exp(2j * np.pi * rng.random(len(spectrum)))
    turn[0] = 1
    if len(x) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(spectrum * turn, len(x))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out[low] -= 1 / x[low]
        x[low] += 1
    r = 1 / x**2
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def transfer_entropy(source: np.ndarray, target: np.ndarray, k: int = 4, seed: int = 0) -> float:
    """Nats that the source's present tells of the target's next value beyond the target's present: k nearest neighbours in the largest norm.

    Series are standardised and jittered by 1e-10; constant ones give NaN. Neighbours are looked up in cells, balls counted by ranks.
    """
    rng = np.random.default_rng(seed)
    if not (np.std(source) > 0 and np.std(target) > 0) or len(source) < k + 3:
        return math.nan
    s, y = ((v - v.mean()) / v.std() + 1e-10 * rng.standard_normal(len(v)) for v in (source, target))
    a, b, c = y[1:], y[:-1], s[:-1]
    e = nearest.kth_distance(np.stack([a, b, c], 1), k)
    own, with_next, with_source = nearest.ball_counts(b, None, e), nearest.ball_counts(b, a, e), nearest.ball_counts(b, c, e)
    return float(np.mean(digamma(np.full(len(a), float(k))) + digamma(own + 1.0) - digamma(with_next + 1.0) - digamma(with_source + 1.0)))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = (y > 0) & (y < 1)
    y = np.where(inside, y, 0.5)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(y) + b * np.log1p(-y)) / a
    tiny = lambda v: np.where(v == 0, 1e-300, v)
    c, d = np.ones_like(y), 1 / tiny(1 - (a + b) * y / (a + 1))
    f = d.copy()
    for m in range(1, 300):
        for n in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / tiny(1 + n * d)
            c = tiny(1 + n / c)
            f = f * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    out = np.where(inside, front * f, 0.0)
    return np.where(turned, 1 - out, out)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t; missing where t is or the degrees of freedom are not positive."""
    t, dof = (np.asarray(v, float) for v in np.broadcast_arrays(t, dof))
    ok = (dof > 0) & np.isfinite(t)
    safe = np.where(ok, dof, 1.0)
    u = np.where(ok, t, 0.0)
    return np.where(ok, beta_inc(safe / 2, 0.5, safe / (safe + u * u)), np.nan)


def pearson_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation of n pairs: 0 for a perfect one, missing for fewer than three pairs."""
    r, n = (np.asarray(v, float) for v in np.broadcast_arrays(r, n))
    inside = (n >= 3) & (np.abs(r) < 1)
    x, m = np.where(inside, r, 0.0), np.where(inside, n, 3.0)
    p = t_two_sided(x * np.sqrt((m - 2) / (1 - x * x)), np.maximum(m - 2, 1e-9))
    return np.where(inside & (n > 2), p, np.where((n >= 3) & (np.abs(r) == 1), 0.0, np.nan))


def newey_west(x: np.ndarray, y: np.ndarray, lag: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares coefficients (a constant first) and their standard errors with Bartlett weights."""
    z = np.column_stack([np.ones(len(y)), x])
    inverse = np.linalg.pinv(z.T @ z)
    b = inverse @ z.T @ y
    u = z * (y - z @ b)[:, None]
    s = u.T @ u
    for k in range(1, lag + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lag + 1)) * (g + g.T)
    return b, np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))


def fit(f, x: np.ndarray, y: np.ndarray, start: list[float], steps: int = 200) -> tuple[np.ndarray, float]:
    """Damped least squares with numerical slopes: parameters and the sum of squares."""
    p, damp = np.array(start, float), 1e-3
    r = y - f(x, *p)
    best = float(r @ r)
    for _ in range(steps):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        j = np.column_stack([(f(x, *(p + np.eye(len(p))[i] * h[i])) - f(x, *p)) / h[i] for i in range(len(p))])
        a = j.T @ j
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), j.T @ r, rcond=None)[0]
        with np.errstate(all="ignore"):
            trial = y - f(x, *(p + step))
        if np.isfinite(trial).all() and (cost := float(trial @ trial)) < best:
            done = best - cost < 1e-14 * (best + 1e-300)
            p, r, best, damp = p + step, trial, cost, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p, best


def bessel_ratio(x: np.ndarray) -> np.ndarray:
    """I1(x) / I0(x) of the modified Bessel functions, an odd function, by its continued fraction from far out inwards; 1 for infinite x."""
    sign, x = np.sign(x), np.abs(np.asarray(x, float))
    big = x > 700
    y = np.where(big, 1.0, x)
    out = np.zeros_like(y)
    for k in range(int(60 + 2 * min(700.0, y.max(initial=0.0))), 0, -1):
        out = 1 / (2 * k / np.maximum(y, 1e-300) + out)
    with np.errstate(invalid="ignore", divide="ignore"):
        far = np.where(np.isinf(x), 1.0, 1 - 0.5 / x - 0.125 / x**2 - 0.125 / x**3)
    return sign * np.where(big, far, np.where(y > 0, out, 0.0))


#: Closures of coherence r against the gradient d with one parameter, and where their fits start. Fixed forms.
CLOSURES = {
    "bessel": (lambda d, k: bessel_ratio(np.where(d > 0, k / np.maximum(d, 1e-12), np.inf)), [1.0]),
    "weak": (lambda d, k: np.where(d > 0, k / (2 * np.maximum(d, 1e-12)), 1.0), [1.0]),
    "simple": (lambda d, tau: 1 / np.sqrt(1 + tau * np.maximum(d, 0.0)), [1.0]),
}

#: Families of coherence against energy, and where their fits start. Fixed forms.
FAMILIES = {
    "registered": (lambda e, tau: (1 + tau * e) ** -0.5, [144.0]),
    "power": (lambda e, a, tau, b: (a + tau * e) ** -b, [1.0, 144.0, 0.5]),
    "exp": (lambda e, r0, tau: r0 * np.exp(-tau * e), [1.0, 1.0]),
    "saturating": (lambda e, low, r0, tau: low + (r0 - low) * np.exp(-tau * e), [0.0, 1.0, 1.0]),
}


def scored(forms: dict, d: np.ndarray, r: np.ndarray) -> list[tuple[str, int, list[float], float, float, float, float]]:
    """(form, parameters' number and values, sum of squares, reduced chi-square against the sample variance, AIC, BIC), the best AIC first; at least six rows."""
    out, n = [], len(d)
    for name, (f, start) in forms.items():
        p, ss = fit(f, d, r, start)
        k = len(p)
        log = n * (math.log(2 * math.pi * max(ss, 1e-300) / n) + 1)
        out.append((name, k, p.tolist(), ss, ss / (max(n - k, 1) * float(np.var(r, ddof=1))), log + 2 * k, log + k * math.log(n)))
    return sorted(out, key=lambda x: (x[5], x[0]))


def _away(lat: np.ndarray, lon: np.ndarray, i: int, at: list[int]) -> np.ndarray:
    """Great-circle distances (km) of place i from others; lat, lon in radians."""
    h = np.sin((lat[at] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[at]) * np.sin((lon[at] - lon[i]) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))


def decided(lat: np.ndarray, lon: np.ndarray, state: np.ndarray, own: np.ndarray, km: float) -> np.ndarray:
    """One scan over places in order, some with a state: 1 seed, 0 none, -1 not known. A place within km of an earlier seed is none, of an earlier unknown place unknown, else a seed if it is
    an own one, whose neighbours are all here."""
    a, o, out = np.radians(lat), np.radians(lon), state.copy()
    seeds, unknown = [], []
    for i in range(len(out)):
        if out[i] < 0:
            if seeds and _away(a, o, i, seeds).min() <= km:
                out[i] = 0
            elif own[i] and not (unknown and _away(a, o, i, unknown).min() <= km):
                out[i] = 1
        if out[i]:
            (seeds if out[i] > 0 else unknown).append(i)
    return out


def nearest_seed(lat: np.ndarray, lon: np.ndarray, block: np.ndarray, km: float) -> np.ndarray:
    """The number of the nearest earlier seed of each place without a number (-1) among places in order; of equally near ones the first."""
    a, o, out, seeds = np.radians(lat), np.radians(lon), block.copy(), []
    for i in range(len(out)):
        if block[i] >= 0:
            seeds.append(i)
        elif seeds:
            d = _away(a, o, i, seeds)
            out[i] = block[seeds[int(d.argmin())]] if d.min() <= km else -1
    return out


def blocks(lat: np.ndarray, lon: np.ndarray, km: float) -> np.ndarray:
    """Greedy blocks in the order given: each place joins the nearest seed within km / 2, or becomes one."""
    state = decided(lat, lon, np.full(len(lat), -1), np.full(len(lat), True), km / 2)
    return nearest_seed(lat, lon, np.where(state == 1, state.cumsum() - 1, -1), km / 2)


def patch_labels(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A label for each cell (i, j), the same for cells connected by edges: the least place of its patch, i * 2^32 + j."""
    left = set(zip(i.tolist(), j.tolist(), strict=True))
    label = {}
    while left:
        todo, patch = [left.pop()], []
        while todo:
            a, b = here = todo.pop()
            patch.append(here)
            for beside in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if beside in left:
                    left.remove(beside)
                    todo.append(beside)
        a, b = min(patch)
        label |= dict.fromkeys(patch, (a << 32) + b)
    return np.array([label[c] for c in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
