"""Signed permutations: how a tag's axes lie in the animal's body."""

from __future__ import annotations

import itertools

import numpy as np

AXES = "xyz"


def is_signed_permutation(m) -> bool:
    m = np.asarray(m, float)
    return m.shape == (3, 3) and bool(np.all(np.isin(m, (-1, 0, 1)))) and bool(np.all(np.abs(m).sum(0) == 1)) and bool(np.all(np.abs(m).sum(1) == 1))


def determinant(m) -> int:
    return int(round(float(np.linalg.det(np.asarray(m, float)))))


def is_proper(m) -> bool:
    """A rotation, not a mirror image."""
    return is_signed_permutation(m) and determinant(m) == 1


def compose(second, first) -> np.ndarray:
    """The matrix of `first` and then `second`."""
    return (np.asarray(second) @ np.asarray(first)).astype(int)


def inverse(m) -> np.ndarray:
    return np.asarray(m, int).T


def proper_rotations() -> list[np.ndarray]:
    """All 24."""
    out = []
    for order in itertools.permutations(range(3)):
        for signs in itertools.product((1, -1), repeat=3):
            m = np.zeros((3, 3), int)
            m[range(3), order] = signs
            if determinant(m) == 1:
                out.append(m)
    return out


def from_rows(rows: list[tuple[str, str]], family: str) -> tuple[np.ndarray | None, list[str]]:
    """The matrix of from/to rows such as ``("ax", "-ay")`` (raw ax becomes minus body ay), and what is dropped.

    None if the family is not mapped whole.
    """
    p = {"accel": "a", "gyro": "g", "mag": "m"}[family]
    m, dropped = np.zeros((3, 3), int), []
    for source, target in rows:
        if source[:1] != p or source[1:] not in AXES:
            continue
        if target.upper() == "NA":
            dropped.append(source)
            continue
        sign, name = (-1, target[1:]) if target.startswith("-") else (1, target)
        m[AXES.index(name[1:]), AXES.index(source[1:])] = sign
    return (m if is_signed_permutation(m) else None), dropped


def to_rows(m, family: str) -> list[tuple[str, str]]:
    p = {"accel": "a", "gyro": "g", "mag": "m"}[family]
    m = np.asarray(m, int)
    out = []
    for k in range(3):
        r = int(np.flatnonzero(m[:, k])[0])
        out.append((p + AXES[k], ("-" if m[r, k] < 0 else "") + p + AXES[r]))
    return out
