"""The largest eigenpairs of a symmetric matrix that is known by its products alone.

Block Jacobi-Davidson: Ritz pairs come from the subspace by Rayleigh-Ritz; those whose residual is at
rounding level are locked and projected out; for the others the projected correction equations
(I - Q Q')(A - theta I)(I - Q Q') t = -r are solved roughly by MINRES, all at once, so that one product with
a block serves every equation; the corrections extend the subspace. Only blocks of a few vectors are
held here. Where the subspace becomes the whole space, Rayleigh-Ritz is the solution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]
#: Vectors beside those wanted, MINRES steps of a correction, outer steps without an end.
GUARD, STEPS, MOST_ROUNDS = 8, 6, 300
#: Residuals count as rounding errors below this times the largest eigenvalue.
ROUNDING = 64 * np.finfo(float).eps


def _orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The block's directions that the orthonormal ``others`` lack; those that are next to nothing go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for other in others:
            block = block - other @ (other.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    return block


def minres(product: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of a symmetric system, a column each, all with the same products."""

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, 1)

    beta = np.linalg.norm(right, axis=0)
    v, v_old, x = right / safe(beta), np.zeros_like(right), np.zeros_like(right)
    w, w_old, eta, least = np.zeros_like(right), np.zeros_like(right), beta.copy(), 1e-14 * beta
    c = c_old = np.ones(len(beta))
    s = s_old = np.zeros(len(beta))
    beta = np.zeros(len(eta))
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, beta_new)
        live = (rho > 0) & (np.abs(eta) > least)
        w_new = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / safe(rho)
        c_old, s_old, c, s = c, s, delta / safe(rho), beta_new / safe(rho)
        x += np.where(live, c * eta * w_new, 0)
        eta = np.where(live, -s * eta, 0)
        w_old, w, v_old, v, beta = w, w_new, v, p / safe(beta_new), beta_new
    return x


def largest_eigenpairs(product: Product, size: int, count: int, steps: int = STEPS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric
    matrix of ``size`` rows without negative eigenvalues; ``product`` multiplies it with a block."""
    count = min(count, size)
    width = min(size, count + GUARD)
    most = min(size, max(3 * width, width + 32))
    rng = np.random.default_rng(seed)
    basis = _orthonormal(rng.standard_normal((size, width)))
    image = product(basis)
    locked = locked_image = np.zeros((size, 0))
    best, idle = np.inf, 0
    for _ in range(MOST_ROUNDS):
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        want = count - locked.shape[1]
        rest = image - basis * values
        rest -= locked @ (locked.T @ rest)
        error = np.linalg.norm(rest, axis=0)[:want]
        scale = max([values[0], *np.linalg.norm(locked_image, axis=0)])
        whole = locked.shape[1] + basis.shape[1] == size
        # Products carry rounding errors of their own; where steps no longer help, those are reached.
        idle = idle + 1 if error.max() > best / 2 else 0
        best = min(best, error.max())
        done = error <= (ROUNDING if idle < 4 else 1e3 * ROUNDING) * scale
        ready = want if whole else int(np.argmin(np.append(done, False)))
        if ready:
            locked, locked_image = np.hstack([locked, basis[:, :ready]]), np.hstack([locked_image, image[:, :ready]])
            basis, image, rest, error, values = basis[:, ready:], image[:, ready:], rest[:, ready:], error[ready:], values[ready:]
            best, idle = np.inf, 0
            if locked.shape[1] == count:
                break
        want = count - locked.shape[1]
        if basis.shape[1] >= most:
            basis, image, rest, values = (x[..., : max(want + GUARD, most // 2)] for x in (basis, image, rest, values))
        near = np.hstack([locked, basis])
        pick = np.flatnonzero(error[:want] > ROUNDING * scale)[: size - near.shape[1]]

        def projected(block: np.ndarray, near=near, shift=values[pick]) -> np.ndarray:
            block = block - near @ (near.T @ block)
            out = product(block) - block * shift
            return out - near @ (near.T @ out)

        new = _orthonormal(minres(projected, -rest[:, pick], steps), near, near)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((size, 1)), near, near)
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise RuntimeError("eigenvectors were not found to double precision")
    inner = locked.T @ locked_image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], locked @ turn[:, ::-1]
