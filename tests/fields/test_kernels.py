import math

import numpy as np
import pytest

from tesserae.functions import kernels as k


def response(sections, f):
    z = np.exp(-1j * np.pi * f)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections])


@pytest.mark.parametrize(("low", "high"), [(0.05, 0.2), (2 / 120, 2 / 24), (None, 0.15)])
def test_butterworth_has_half_power_at_its_edges(low, high):
    s = k.butterworth(4, low, high)
    for f in [x for x in (low, high) if x]:
        assert abs(response(s, f)) == pytest.approx(math.sqrt(0.5), abs=1e-6)
    middle = math.sqrt(low * high) if low else 1e-6
    assert abs(response(s, middle)) == pytest.approx(1, abs=0.02)
    assert abs(response(s, 0.9)) < 1e-3 and (low is None or abs(response(s, low / 8)) < 1e-3)


def test_zero_phase_keeps_a_sine_in_band_and_drops_others():
    t = np.arange(600)
    inside, outside = np.sin(2 * np.pi * t / 48), np.sin(2 * np.pi * t / 6)
    s = k.butterworth(4, 2 / 120, 2 / 24)
    got = k.zero_phase(s, np.array([inside + outside + 3]))[0]
    assert np.abs(got - inside)[220:-220].max() < 0.03
    assert k.zero_phase(k.butterworth(4, None, 0.1), np.full((1, 100), 2.5)) == pytest.approx(2.5)


def test_analytic_phase_and_morlet():
    t = np.arange(480)
    x = np.cos(2 * np.pi * t / 40)[None]
    phase = np.angle(k.analytic(x))[0]
    assert np.abs(np.angle(np.exp(1j * (phase - 2 * np.pi * t / 40)))).max() < 1e-6
    m = k.morlet_phase(x, 40)[0]
    ok = ~np.isnan(m)
    assert ok.sum() > 200 and np.abs(np.angle(np.exp(1j * (m - 2 * np.pi * t / 40))))[ok].max() < 0.05


def test_spectrum_peaks_and_surrogates_keep_it():
    t = np.arange(256)
    f, p = k.welch(np.sin(2 * np.pi * t / 4), 16)
    assert f[p.argmax()] == 0.25 and np.trapezoid(p, f) == pytest.approx(1)
    x = np.random.default_rng(1).normal(size=101)
    y = k.surrogate(x, np.random.default_rng(2))
    assert np.abs(np.fft.rfft(x)) == pytest.approx(np.abs(np.fft.rfft(y))) and not np.allclose(x, y)


def test_special_functions():
    assert k.digamma(np.array([1.0, 2.0, 10.5])) == pytest.approx([-0.5772156649, 0.4227843351, 2.3030010343])
    assert k.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    x = np.linspace(-60, 60, 2_000_001)
    for t, dof in ((2.0, 10), (0.5 * math.sqrt(18 / 0.75), 18)):
        density = (1 + x * x / dof) ** (-(dof + 1) / 2)
        assert k.t_two_sided(t, dof) == pytest.approx(np.trapezoid(density * (np.abs(x) > t), x) / np.trapezoid(density, x), abs=1e-5)
    assert k.pearson_p(0.5, 20) == pytest.approx(k.t_two_sided(0.5 * math.sqrt(18 / 0.75), 18))


def test_transfer_entropy_sees_the_direction():
    r = np.random.default_rng(0)
    x, y = r.normal(size=1500), np.zeros(1500)
    x2, y2 = np.zeros(1500), r.normal(size=1500)
    for t in range(1, 1500):
        x2[t] = 0.5 * x2[t - 1] + 0.7 * y2[t - 1] + 0.3 * r.normal()
    y = r.normal(size=1500)
    assert abs(k.transfer_entropy(x, y)) < 0.05
    forth, back = k.transfer_entropy(y2, x2), k.transfer_entropy(x2, y2)
    assert forth > 0.2 and forth > 5 * abs(back)
    assert math.isfinite(k.transfer_entropy(x[:30], y[:30])) and math.isnan(k.transfer_entropy(np.ones(50), x[:50]))


def test_fits_recover_parameters():
    d = np.logspace(-3, 0, 200)
    noise = 0.01 * np.random.default_rng(3).normal(size=200)
    for name, p, forms in (("simple", [50.0], k.CLOSURES), ("bessel", [0.3], k.CLOSURES), ("registered", [144.0], k.FAMILIES), ("exp", [0.9, 3.0], k.FAMILIES), ("saturating", [0.2, 0.8, 5.0], k.FAMILIES)):
        r = forms[name][0](d, *p) + noise
        found = {f[0]: f for f in k.scored(forms, d, r)}
        assert found[name][2] == pytest.approx(p, rel=0.15)
        assert k.scored(forms, d, r)[0][0] == name or name in ("registered", "exp")
        ss, n, q = found[name][3], 200, len(p)
        assert found[name][4] == pytest.approx(ss / ((n - q) * np.var(r, ddof=1))) and found[name][5] == pytest.approx(2 * q + n * (math.log(2 * math.pi * ss / n) + 1))


def test_closures_by_hand():
    d = np.array([0.0, 0.5, 2.0])
    assert k.CLOSURES["simple"][0](d, 4.0) == pytest.approx([1, 3**-0.5, 1 / 3])
    assert k.CLOSURES["weak"][0](d, 1.0) == pytest.approx([1, 1, 0.25])
    x = np.array([0.3, 2.0, 20.0, 900.0])
    angle = np.linspace(0, np.pi, 100_001)
    whole = lambda n, v: np.trapezoid(np.exp(v * (np.cos(angle) - 1)) * np.cos(n * angle), angle)
    assert k.bessel_ratio(x) == pytest.approx([whole(1, v) / whole(0, v) for v in x]) and k.CLOSURES["bessel"][0](d, 1.0)[0] == 1


def test_error_function_on_arrays():
    x = np.linspace(-7, 7, 701)
    assert k.erf(x) == pytest.approx([math.erf(v) for v in x], abs=1e-12) and np.isnan(k.erf(np.array([np.nan])))[0]
    assert k.log_gamma(np.array([0.1, 1.0, 5.5, 60.0])) == pytest.approx([math.lgamma(v) for v in (0.1, 1.0, 5.5, 60.0)], abs=1e-10)


def test_newey_west_and_patches_and_blocks():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.1 * r.normal(size=400)
    b, e = k.newey_west(x, y)
    assert b == pytest.approx([1, 2, -1], abs=0.03) and (e < 0.02).all()
    assert k.patch_labels(np.array([1, 0, 5, 1, 2]), np.array([0, 1, 5, 1, 2])).tolist() == [1, 1, (5 << 32) + 5, 1, (2 << 32) + 2]
    lat, lon = np.array([0.0, 0.1, 10.0, 10.1, 0.2]), np.zeros(5)
    assert k.blocks(lat, lon, 500).tolist() == [0, 0, 1, 1, 0]
