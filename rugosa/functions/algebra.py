"""Small linear systems and sums as SQL text and columns."""

from __future__ import annotations


def det(m: list[list[str]]) -> str:
    """Determinant of a matrix of SQL expressions, by its first row."""
    if len(m) == 1:
        return m[0][0]
    parts = []
    for j, a in enumerate(m[0]):
        minor = det([[x for k, x in enumerate(row) if k != j] for row in m[1:]])
        parts.append(f"{'-' if j % 2 else '+'} {a} * ({minor})")
    return "(" + " ".join(parts).removeprefix("+ ") + ")"


def cramer(m: list[list[str]], b: list[str]) -> list[str]:
    """The solution of m x = b, each unknown as SQL text; null for a singular matrix."""
    d = det(m)
    return [f"({det([[b[i] if k == j else x for k, x in enumerate(row)] for i, row in enumerate(m)])} / nullif({d}, 0))" for j in range(len(b))]


def normal_equations(basis: list[str], value: str) -> tuple[dict[str, str], list[list[str]], list[str]]:
    """Sums (name to SQL text) of a least-squares fit on the basis, and matrix and right side in those names."""
    sums: dict[str, str] = {}
    n = len(basis)
    m = [["" for _ in range(n)] for _ in range(n)]
    for i in range(n):
        for j in range(i, n):
            sums[f"s{i}{j}"] = f"sum(({basis[i]}) * ({basis[j]}))"
            m[i][j] = m[j][i] = f"s{i}{j}"
        sums[f"t{i}"] = f"sum(({basis[i]}) * ({value}))"
    return sums, m, [f"t{i}" for i in range(n)]
