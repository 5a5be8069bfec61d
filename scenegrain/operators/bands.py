"""All eigenvalues of a symmetric matrix in half the room: dense to banded to tridiagonal, then by halving intervals.

Half of the matrix is kept, in strips of columns; what is below a band goes panel by panel (products of matrices, unlike the
direct way to a tridiagonal one, whose products of a matrix and a vector read it all for each column).
"""

from __future__ import annotations

import os

import numpy as np

WIDTH = 64


def reflectors(panel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, t, r) of a panel = (I - v t v') [r; 0]."""
    h, tau = np.linalg.qr(panel, mode="raw")
    k = len(tau)
    v = np.tril(h.T[:, :k], -1)
    v[np.arange(k), np.arange(k)] = 1
    v[:, tau == 0] = 0
    t = np.linalg.inv(np.triu(v.T @ v, 1) + np.diag(1 / np.where(tau == 0, 1, tau)))
    return v, t, np.triu(h.T[:k])


class Filed:
    """A list of strips, each in a file of the folder: as much of a matrix is in memory as is asked for."""

    def __init__(self, folder: str) -> None:
        self.folder, self.shapes = folder, []

    def __len__(self) -> int:
        return len(self.shapes)

    def append(self, strip: np.ndarray) -> None:
        self.shapes.append(None)
        self[len(self) - 1] = strip

    def __getitem__(self, i: int) -> np.ndarray:
        return np.fromfile(f"{self.folder}/{i}").reshape(self.shapes[i])

    def __setitem__(self, i: int, strip: np.ndarray | None) -> None:
        if strip is None:
            os.remove(f"{self.folder}/{i}")
        else:
            self.shapes[i] = strip.shape
            strip.tofile(f"{self.folder}/{i}")


def to_band(strips: list[np.ndarray] | Filed, width: int = WIDTH, chunk: int = 1024) -> np.ndarray:
    """The lower band (n, width + 1; row j: the entries of column j from the diagonal down) of a matrix with the same
    eigenvalues. `strips` are its columns, each strip from its own first row down, a multiple of `width` wide; they are
    overwritten and freed. What a panel changes reaches the strips when the next one passes over them."""
    n, side = strips[0].shape
    band = np.zeros((n, width + 1))
    left = right = None

    def keep(j: int, part: np.ndarray) -> None:
        """Columns from j on: part's rows are those from j on."""
        for c in range(part.shape[1]):
            band[j + c, : len(part) - c] = part[c : c + width + 1, c]

    for j in range(0, n, width):
        at, first = divmod(j, side)
        strip = strips[at]
        own = strip[first:, first : first + width].copy()
        b, m = own.shape[1], len(own) - own.shape[1]
        if left is not None:
            own -= left @ right[:b].T
        if m <= 0:
            keep(j, own)
            break
        v, t, r = reflectors(own[b:])
        keep(j, np.concatenate((own[:b], r)))
        low = j + b  # rows and columns that are left; v and z have a row for each, left and right one for each from j
        z = np.zeros_like(v)
        for i in range(low // side, len(strips)):
            whole = strip if i == at else strips[i]
            c0 = max(low, i * side)
            part, o = whole[c0 - i * side :, c0 - i * side :], c0 - low
            k = part.shape[1]
            for a in range(0, len(part), chunk):
                rows = part[a : a + chunk]
                if left is not None:
                    rows -= left[b + o + a : b + o + a + len(rows)] @ right[b + o : b + o + k].T
                z[o + a : o + a + len(rows)] += rows @ v[o : o + k]
                below = max(0, min(k - a, len(rows)))  # the first k rows of a strip are a square on the diagonal
                z[o : o + k] += rows[below:].T @ v[o + a + below : o + a + len(rows)]
            if left is not None:
                strips[i] = whole
        y = z @ t
        w = y - v @ (t.T @ (v.T @ y) / 2)
        left, right = np.concatenate((v, w), 1), np.concatenate((w, v), 1)
        if low % side == 0:
            strips[at] = None
    return band


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, beta): (I - tau v v') x has beta in front and zeros behind."""
    s = float(x[1:] @ x[1:])
    if s == 0:
        return np.eye(1, len(x))[0], 0.0, float(x[0])
    beta = -np.copysign((x[0] * x[0] + s) ** 0.5, x[0])
    v = x / (x[0] - beta)
    v[0] = 1
    return v, float((beta - x[0]) / beta), float(beta)


def to_tridiagonal(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, what is below it) of a tridiagonal matrix with the eigenvalues of a lower band. Column by column, the bulge
    that a reflection makes is chased down the band."""
    n, b = len(band), band.shape[1] - 1
    far = 4 * b + 2
    flat = np.zeros((n + 1) * (far + 1))
    # m[j, i] is the entry of column j and row i. Column j starts at j * (far + 1), so an entry with i < j falls into the part
    # of the column before that neither band nor bulge reaches.
    m = np.lib.stride_tricks.as_strided(flat, (n, n), (8 * far, 8))
    for k in range(min(b + 1, n)):
        at = np.arange(n - k)
        flat[at * far + at + k] = band[: n - k, k]
        flat[(at + k) * far + at] = band[: n - k, k]
    up, across = np.empty((b, 2)), np.empty((2, b))  # of products of two columns and two rows
    for j in range(n - 2):
        s, e = j + 1, min(j + 1 + b, n)
        v, tau, beta = reflector(m[j, s:e].copy())
        m[j, s], m[j, s + 1 : e] = beta, 0
        while True:
            k = e - s
            if tau:
                d = m[s:e, s:e]
                w = d @ v
                w *= tau
                w -= (tau / 2 * float(w @ v)) * v
                up[:k, 0], up[:k, 1], across[0, :k], across[1, :k] = v, w, w, v
                d -= np.dot(up[:k], across[:, :k])
            end = min(e + b, n)
            if end <= e:
                break
            f = m[s:e, e:end]  # a row for each column of the bulge
            right = tau * (v @ f)
            u, tau, beta = reflector(f[0] - right if tau else f[0].copy())  # v starts with 1
            left = f @ u - float(right @ u) * v
            up[:k, 0], up[:k, 1], across[0, : end - e], across[1, : end - e] = v, left, right, tau * u
            f -= np.dot(up[:k], across[:, : end - e])
            f[0, 0], f[0, 1:] = beta, 0
            m[e, s:e] = f[:, 0]  # the next column's reflection works on whole squares, one further down
            s, e, v = e, end, u
    at = np.arange(n)
    return flat[at * (far + 1)], flat[at[: n - 1] * (far + 1) + 1]


def tridiagonal_values(d: np.ndarray, e: np.ndarray, steps: int = 53, part: int = 8192) -> np.ndarray:
    """All eigenvalues, rising, of a tridiagonal matrix: intervals are halved by how many lie below their middle."""
    n = len(d)
    e2 = np.maximum(np.concatenate(([0.0], e * e)), 1e-300)
    reach = np.abs(np.concatenate(([0.0], e, [0.0])))
    reach = reach[1:] + reach[:-1]
    low, high = float((d - reach).min()), float((d + reach).max())
    room = 1e-15 * max(abs(low), abs(high), 1e-300)
    out = []
    for i in range(0, n, part):
        k = np.arange(i, min(i + part, n))
        lo, hi = np.full(len(k), low - room), np.full(len(k), high + room)
        for _ in range(steps):
            x = (lo + hi) / 2
            q, below, less = np.full(len(k), 1.0), np.zeros(len(k), np.int64), np.empty(len(k), bool)
            with np.errstate(divide="ignore", over="ignore"):
                for a, c in zip(d.tolist(), e2.tolist()):
                    np.divide(c, q, out=q)
                    q += x
                    np.subtract(a, q, out=q)
                    below += np.less(q, 0, out=less)
            up = below <= k
            lo, hi = np.where(up, x, lo), np.where(up, hi, x)
        out.append((lo + hi) / 2)
    return np.concatenate(out)


def values(strips: list[np.ndarray] | Filed, width: int = WIDTH) -> np.ndarray:
    """All eigenvalues, rising, of a matrix in strips as to_band() takes them. A small one is solved whole."""
    n = len(strips[0])
    if n <= 2048:
        whole = np.zeros((n, n))
        for strip in (strips[i] for i in range(len(strips))):
            whole[n - len(strip) :, n - len(strip) : n - len(strip) + strip.shape[1]] = strip
        return np.linalg.eigvalsh(whole)  # reads the lower half
    return tridiagonal_values(*to_tridiagonal(to_band(strips, width)))
