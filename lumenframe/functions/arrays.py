"""Image and signal kernels on NumPy arrays, for use inside Arrow-backed functions. Images are (rows, columns)."""

from __future__ import annotations

import numpy as np

# ---------------------------------------------------------------- filters


def gaussian_taps(sigma: float, truncate: float = 4.0) -> np.ndarray:
    reach = int(truncate * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return taps / taps.sum()


def filter_axis(image: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with symmetric taps along an axis; the border repeats the edge pixel (symmetric padding)."""
    reach = len(taps) // 2
    pad = [(0, 0)] * image.ndim
    pad[axis] = (reach, reach)
    wide = _symmetric(image, pad, axis)
    n = image.shape[axis]
    return sum(w * np.take(wide, range(i, i + n), axis) for i, w in enumerate(taps))


def _symmetric(image: np.ndarray, pad, axis: int) -> np.ndarray:
    while pad[axis][0] > image.shape[axis]:  # reflect again where the kernel is wider than the image
        reach = image.shape[axis]
        step = [(0, 0)] * image.ndim
        step[axis] = (reach, reach)
        image = np.pad(image, step, mode="symmetric")
        left = pad[axis][0] - reach
        pad = [(0, 0)] * image.ndim
        pad[axis] = (left, left)
    return np.pad(image, pad, mode="symmetric")


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter over the last two axes, cut at 4 sigma."""
    if sigma <= 0:
        return np.asarray(image, float)
    taps = gaussian_taps(sigma)
    return filter_axis(filter_axis(np.asarray(image, float), taps, -1), taps, -2)


def median3(image: np.ndarray) -> np.ndarray:
    """Median of each pixel's 3 x 3 neighbourhood, symmetric border."""
    wide = np.pad(image, 1, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, (3, 3)), axis=(2, 3))


def surround_kernel(sigma: float) -> np.ndarray:
    """Zero-sum Gaussian on a disk of radius 3 sigma: the Gaussian less its mean over the disk."""
    reach = int(np.ceil(3 * sigma))
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    r2 = y * y + x * x
    inside = r2 <= (3 * sigma) ** 2
    g = np.where(inside, np.exp(-r2 / (2 * sigma * sigma)), 0.0)
    return np.where(inside, g - g[inside].mean(), 0.0)


def highpass_kernel(sigma: float) -> np.ndarray:
    """Separable Gaussian window, less its mean over the support where it is at least its value at the middle of an edge."""
    half = int(3 * sigma // 2)
    g1 = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    g1 /= g1.sum()
    g = np.outer(g1, g1)
    inside = g >= g[:, 0].max()
    return np.where(inside, g - g[inside].mean(), 0.0)


def convolve(images: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size correlation of the last two axes with a point-symmetric kernel, symmetric border, by FFT."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = _symmetric(images, _pads(images.ndim, -2, ry), images.ndim - 2)
    wide = _symmetric(wide, _pads(images.ndim, -1, rx), images.ndim - 1)
    shape = wide.shape[-2:]
    spectrum = np.fft.rfft2(wide) * np.fft.rfft2(kernel, shape)
    full = np.fft.irfft2(spectrum, shape)
    return full[..., 2 * ry : 2 * ry + images.shape[-2], 2 * rx : 2 * rx + images.shape[-1]]


def _pads(ndim: int, axis: int, reach: int):
    pad = [(0, 0)] * ndim
    pad[axis] = (reach, reach)
    return pad


def laplacian_of_gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Scale-normalised negative Laplacian of the Gaussian-smoothed image: bright blobs are positive."""
    smooth = gaussian(image, sigma)
    wide = np.pad(smooth, 1, mode="symmetric")
    lap = wide[2:, 1:-1] + wide[:-2, 1:-1] + wide[1:-1, 2:] + wide[1:-1, :-2] - 4 * smooth
    return -lap * sigma * sigma


# ---------------------------------------------------------------- morphology


def diamond(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return np.abs(y) + np.abs(x) <= radius


def dilate(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    ry, rx = footprint.shape[0] // 2, footprint.shape[1] // 2
    wide = np.pad(mask, ((ry, ry), (rx, rx)))
    out = np.zeros_like(mask)
    for dy, dx in zip(*np.nonzero(footprint)):
        out |= wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def erode(mask: np.ndarray, footprint: np.ndarray) -> np.ndarray:
    """Outside of the image counts as off, so masks shrink at its edge."""
    ry, rx = footprint.shape[0] // 2, footprint.shape[1] // 2
    wide = np.pad(mask, ((ry, ry), (rx, rx)))
    out = np.ones_like(mask)
    for dy, dx in zip(*np.nonzero(footprint)):
        out &= wide[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def close(mask: np.ndarray, radius: int) -> np.ndarray:
    box = np.ones((2 * radius + 1, 2 * radius + 1), bool)
    return erode(dilate(mask, box), box) if radius else mask


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Connected regions numbered from 1 by their first pixel in row-major order; 0 is outside."""
    h, w = mask.shape
    ids = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        new = ids.copy()
        for dy, dx in steps:
            a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
            b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
            both = mask[a] & mask[b]
            least = np.minimum(new[a], new[b])
            new[a] = np.where(both, np.minimum(new[a], least), new[a])
            new[b] = np.where(both, np.minimum(new[b], least), new[b])
        flat = new.ravel()
        inside = flat > 0
        flat[inside] = flat[flat[inside] - 1]  # follow the smallest pixel found so far
        if (new == ids).all():
            break
        ids = new
    return np.searchsorted(np.unique(ids), ids) + (0 if (ids == 0).any() else 1)


def largest_region(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """The region with most pixels, the first one of equals."""
    regions = label(mask, diagonal)
    sizes = np.bincount(regions.ravel())
    if len(sizes) < 2:
        return np.zeros_like(mask)
    return regions == 1 + int(np.argmax(sizes[1:]))


def clip_to_circle(image: np.ndarray, factor: float, cap: float | None = None) -> np.ndarray:
    """Zero beyond factor times the radius of a disk of the support's area, about the weighted centroid."""
    y, x = np.nonzero(image > 0)
    if not len(y):
        return image
    w = image[y, x]
    cy, cx = (w * y).sum() / w.sum(), (w * x).sum() / w.sum()
    reach = factor * np.sqrt(len(y) / np.pi)
    reach = reach if not cap else min(reach, cap)
    yy, xx = np.mgrid[: image.shape[0], : image.shape[1]]
    return np.where((yy - cy) ** 2 + (xx - cx) ** 2 > reach * reach, 0, image)


def trim_footprint(image: np.ndarray, *, method: str = "max", max_share: float = 0.1, energy: float = 0.95, closing: int = 1, circle: float = 1.5, cap: float | None = None) -> np.ndarray:
    """Median filter, threshold by peak share or by energy, closing, largest region, circle."""
    a = np.maximum(median3(image), 0)
    if a.max(initial=0) <= 0:
        return np.zeros_like(a)
    if method == "nrg":
        flat = np.sort(a.ravel())[::-1]
        total = np.cumsum(flat**2)
        level = flat[min(len(flat) - 1, int(np.searchsorted(total, energy * total[-1])))]
        on = (a >= level) & (a > 0)
    elif method == "max":
        on = a >= max_share * a.max()
    else:
        raise ValueError(f"method is 'max' or 'nrg', not {method!r}")
    region = largest_region(close(on, closing))
    return clip_to_circle(np.where(region, a, 0), circle, cap)


def local_maxima(image: np.ndarray, distance: int, above: float | None = None) -> np.ndarray:
    """(row, column) of pixels that are the maximum of their square neighbourhood and over `above`, brightest first.

    A border of that distance is left out; of peaks nearer than distance to a brighter one only that stays.
    """
    d = max(1, int(distance))
    above = image.min() if above is None else above
    wide = np.pad(image, d, constant_values=-np.inf)
    highest = np.lib.stride_tricks.sliding_window_view(wide, (2 * d + 1, 2 * d + 1)).max(axis=(2, 3))
    on = (image == highest) & (image > above)
    on[:d], on[-d:], on[:, :d], on[:, -d:] = False, False, False, False
    y, x = np.nonzero(on)
    order = np.lexsort((x, y, -image[y, x]))
    kept: list[tuple[int, int]] = []
    for i in order:
        if all(max(abs(y[i] - a), abs(x[i] - b)) > d for a, b in kept):
            kept.append((int(y[i]), int(x[i])))
    return np.array(kept, np.int64).reshape(-1, 2)


def blobs(image: np.ndarray, min_sigma: float, max_sigma: float, steps: int = 10, threshold: float = 0.05, overlap: float = 0.5) -> np.ndarray:
    """(row, column, sigma) of maxima over space and scale of the scale-normalised Laplacian, overlapping ones pruned."""
    sigmas = np.linspace(min_sigma, max_sigma, steps)
    cube = np.stack([laplacian_of_gaussian(image, s) for s in sigmas])
    wide = np.pad(cube, 1, constant_values=-np.inf)
    highest = np.lib.stride_tricks.sliding_window_view(wide, (3, 3, 3)).max(axis=(3, 4, 5))
    s, y, x = np.nonzero((cube == highest) & (cube > threshold))
    order = np.lexsort((x, y, -cube[s, y, x]))
    kept: list[tuple[float, float, float]] = []
    for i in order:
        one = (float(y[i]), float(x[i]), float(sigmas[s[i]]))
        if all(_disk_overlap(one, other) <= overlap for other in kept):
            kept.append(one)
    return np.array(kept).reshape(-1, 3)


def _disk_overlap(a, b) -> float:
    """Share of the smaller disk (radius sigma * sqrt 2) that the other covers."""
    r, s = a[2] * np.sqrt(2), b[2] * np.sqrt(2)
    d = np.hypot(a[0] - b[0], a[1] - b[1])
    if d >= r + s:
        return 0.0
    if d <= abs(r - s):
        return 1.0
    p = np.arccos(np.clip((d * d + r * r - s * s) / (2 * d * r), -1, 1))
    q = np.arccos(np.clip((d * d + s * s - r * r) / (2 * d * s), -1, 1))
    lens = r * r * (p - np.sin(2 * p) / 2) + s * s * (q - np.sin(2 * q) / 2)
    return float(lens / (np.pi * min(r, s) ** 2))


def shape_of(mask: np.ndarray) -> dict[str, float]:
    """Eccentricity, solidity, compactness and aspect ratio of the largest 8-connected region; NaN where there is none."""
    nan = float("nan")
    region = largest_region(mask, diagonal=True)
    y, x = np.nonzero(region)
    n = len(y)
    if not n:
        return dict(eccentricity=nan, solidity=nan, compactness=nan, aspect_ratio=nan)
    vy, vx, c = y.var() + 1 / 12, x.var() + 1 / 12, ((y - y.mean()) * (x - x.mean())).mean()
    mid, gap = (vy + vx) / 2, np.sqrt(((vy - vx) / 2) ** 2 + c * c)
    big, small = 4 * np.sqrt(mid + gap), 4 * np.sqrt(max(mid - gap, 0))
    wide = np.pad(region, 1)
    edges = sum(int((wide[1:-1, 1:-1] & ~np.roll(wide, s, a)[1:-1, 1:-1]).sum()) for a in (0, 1) for s in (1, -1))
    perimeter = np.pi / 4 * edges
    return dict(eccentricity=float(np.sqrt(max(0.0, 1 - (small / big) ** 2))), solidity=float(min(1.0, n / hull_area(y, x))), compactness=float(min(1.0, 4 * np.pi * n / perimeter**2)), aspect_ratio=float(big / small) if small > 0 else nan)


def hull_area(y: np.ndarray, x: np.ndarray) -> float:
    """Area of the convex hull of the pixels' squares."""
    corners = {(int(a) + i, int(b) + j) for a, b in zip(y, x) for i in (0, 1) for j in (0, 1)}
    points = sorted(corners)

    def chain(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(points) + chain(points[::-1])
    return 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])))


# ---------------------------------------------------------------- signals


def noise_level(traces: np.ndarray, low: float = 0.25, high: float = 0.5, method: str = "logmexp") -> np.ndarray:
    """Noise deviation of each row from its power spectrum between two frequencies in cycles a sample."""
    n = traces.shape[-1]
    f = np.fft.rfftfreq(n)
    power = np.abs(np.fft.rfft(traces, axis=-1)[..., (f >= low) & (f <= high)]) ** 2 * (2 / n)
    if power.shape[-1] == 0:
        return np.zeros(traces.shape[:-1])
    if method == "mean":
        return np.sqrt(power.mean(-1))
    if method == "median":
        return np.sqrt(np.median(power, -1))
    if method == "logmexp":
        return np.sqrt(np.exp(np.log(power + 1e-10).mean(-1)))
    raise ValueError(f"method is 'mean', 'median' or 'logmexp', not {method!r}")


def neighbour_correlation(movie: np.ndarray) -> np.ndarray:
    """Mean correlation over time of each pixel with those of its 8 neighbours that exist. movie: (t, y, x)."""
    z = movie - movie.mean(0)
    sd = z.std(0)
    z = z / np.where(sd == 0, 1, sd)
    h, w = movie.shape[1:]
    total, count = np.zeros((h, w)), np.zeros((h, w))
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
        r = (z[(slice(None), *a)] * z[(slice(None), *b)]).mean(0)
        total[a] += r
        total[b] += r
        count[a] += 1
        count[b] += 1
    return total / np.maximum(count, 1)


def corr_pnr(movie: np.ndarray, sigma: float | None = None, stride: int = 1, surround: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(correlation image, peak-to-noise image, noise, filtered movie) of a movie (t, y, x).

    The movie is filtered by the zero-sum kernel (without surround: by a Gaussian) if sigma is given, and centred over time; values under three
    times the noise count as 0 for the correlations, which use every stride-th frame.
    """
    f = np.asarray(movie, float)
    if sigma:
        f = convolve(f, surround_kernel(sigma)) if surround else gaussian(f, sigma)
    f = f - f.mean(0)
    sn = noise_level(np.moveaxis(f, 0, -1))
    pnr = np.where(sn > 0, np.maximum(f.max(0), 0) / np.where(sn > 0, sn, 1), 0.0)
    part = f[::stride]
    cn = neighbour_correlation(np.where(part >= 3 * sn, part, 0))
    return cn, pnr, sn, f


def rolling_baseline(trace: np.ndarray, window: int, percentile: float, stride: int | None = None) -> np.ndarray:
    """Percentile of the frames about each anchor, interpolated between anchors. trace: (..., t)."""
    n, half = trace.shape[-1], window // 2
    at = np.unique(np.append(np.arange(0, n, stride or max(1, window // 10)), n - 1))
    low = np.stack([np.percentile(trace[..., max(0, t - half) : t + half + 1], percentile, axis=-1) for t in at], -1)
    right = np.clip(np.searchsorted(at, np.arange(n), side="left"), 1, max(1, len(at) - 1)) if len(at) > 1 else np.zeros(n, int)
    if len(at) == 1:
        return np.broadcast_to(low, trace.shape).copy()
    share = (np.arange(n) - at[right - 1]) / (at[right] - at[right - 1])
    return low[..., right - 1] * (1 - share) + low[..., right] * share


def polynomial_detrend(trace: np.ndarray, order: int) -> np.ndarray:
    """The trace less its least-squares polynomial of that order; order 0 is the mean."""
    if order <= 0:
        return trace - trace.mean()
    t = np.linspace(-1, 1, len(trace))
    return trace - np.polynomial.polynomial.polyval(t, np.polynomial.polynomial.polyfit(t, trace, order))


# ---------------------------------------------------------------- registration


def phase_shift(template: np.ndarray, frame: np.ndarray, upsample: int = 10, limit: tuple[int, int] = (20, 20)) -> tuple[float, float]:
    """Shift (rows, columns) to apply to the frame so that it meets the template, to 1 / upsample of a pixel."""
    a, b = np.fft.fft2(template), np.fft.fft2(frame)
    cross = a * np.conj(b)
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    peak = np.abs(np.fft.ifft2(cross))
    h, w = peak.shape
    for axis, (n, most) in enumerate(zip((h, w), limit)):
        if most > 0 and n - 2 * most > 0:  # a limit of 0 leaves the axis free
            cut = [slice(None), slice(None)]
            cut[axis] = slice(most, n - most)
            peak[tuple(cut)] = 0
    at = np.array(np.unravel_index(np.argmax(peak), peak.shape), float)
    size = np.array([h, w])
    at[at > np.fix(size / 2)] -= size[at > np.fix(size / 2)]
    if upsample <= 1:
        return float(at[0]), float(at[1])
    at = np.round(at * upsample) / upsample
    reach = int(np.ceil(1.5 * upsample))
    fine = (np.arange(reach) - np.fix(reach / 2)) / upsample
    fy, fx = np.fft.fftfreq(h), np.fft.fftfreq(w)
    rows = np.exp(2j * np.pi * np.outer(at[0] + fine, fy))
    cols = np.exp(2j * np.pi * np.outer(fx, at[1] + fine))
    close_up = np.abs(rows @ cross @ cols)
    i, j = np.unravel_index(np.argmax(close_up), close_up.shape)
    return float(at[0] + fine[i]), float(at[1] + fine[j])


def translate(frame: np.ndarray, shift: tuple[float, float]) -> np.ndarray:
    """Bilinear translation by (rows, columns), symmetric border; NaN becomes 0 and nothing is under 0."""
    return np.maximum(np.nan_to_num(sample_bilinear(frame, *_grid(frame.shape, -shift[0], -shift[1]), border="symmetric")), 0)


def _grid(shape, dy: float, dx: float):
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    return y + dy, x + dx


def sample_bilinear(image: np.ndarray, y: np.ndarray, x: np.ndarray, border: str = "zero") -> np.ndarray:
    h, w = image.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    out = np.zeros(y.shape)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            yy, xx = y0 + dy, x0 + dx
            if border == "symmetric":
                yy, xx = np.mod(yy, 2 * h), np.mod(xx, 2 * w)
                v = image[np.where(yy >= h, 2 * h - 1 - yy, yy), np.where(xx >= w, 2 * w - 1 - xx, xx)]
            else:
                inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
                v = np.where(inside, image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], 0)
            out += wy * wx * v
    return out


def bin_median(frames: np.ndarray, window: int = 10) -> np.ndarray:
    """Median over the means of frames whose number leaves the same remainder. frames: (t, y, x)."""
    w = min(window, len(frames))
    groups = len(frames) // w
    return np.nanmedian(np.nanmean(frames[: groups * w].reshape(w, groups, *frames.shape[1:]), axis=0), axis=0)


def rigid_matrix(shape: tuple[int, int], dy: float, dx: float, theta: float) -> np.ndarray:
    """2 x 3 matrix that turns points (y, x) by theta degrees about the image's centre and then moves them."""
    t = np.deg2rad(theta)
    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    c = (np.array(shape) - 1) / 2
    return np.hstack([r, (c - r @ c + [dy, dx])[:, None]])


def warp_points(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return points @ matrix[:, :2].T + matrix[:, 2]


def warp_image(image: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The image moved by the matrix, bilinear, zero outside."""
    back = np.linalg.inv(matrix[:, :2])
    y, x = np.mgrid[: image.shape[0], : image.shape[1]]
    at = (np.stack([y.ravel(), x.ravel()], 1) - matrix[:, 2]) @ back.T
    return sample_bilinear(image, at[:, 0], at[:, 1]).reshape(image.shape)


def normalised_correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / scale) if scale > 0 else 0.0


def upsample_image(image: np.ndarray, shape: tuple[int, int], order: int = 1) -> np.ndarray:
    """Resize with half-pixel centres; order 1 is bilinear with the edge repeated, order 0 nearest."""
    at = [np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in zip(shape, image.shape)]
    if order == 0:
        return image[np.ix_(*(np.floor(a + 0.5).astype(int) for a in at))]
    y, x = np.meshgrid(*at, indexing="ij")
    return sample_bilinear(image, y, x, border="symmetric")
