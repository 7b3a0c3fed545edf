"""Squares and square sets as SQL expressions.

Squares are 0..63, file * 8 + rank; a square set is a BIGINT with bit 63 as its sign. Sides are 0
(white) and 1 (black); pieces 0..5 pawn, knight, bishop, rook, queen, king.
"""

from __future__ import annotations

PIECES = ("pawn", "knight", "bishop", "rook", "queen", "king")


def _mask(squares) -> int:
    m = sum(1 << s for s in squares)
    return m - (1 << 64) if m >> 63 else m


#: Set constants, from the square numbering alone.
FILES = tuple(_mask(range(8 * f, 8 * f + 8)) for f in range(8))
RANKS = tuple(_mask(range(r, 64, 8)) for r in range(8))
NOT_A = _mask(range(8, 64))
NOT_H = _mask(range(56))
NOT_RANK_1 = _mask(s for s in range(64) if s % 8 != 0)
NOT_RANK_8 = _mask(s for s in range(64) if s % 8 != 7)
COLOURS = tuple(_mask(s for s in range(64) if ((s >> 3) ^ s) & 1 == c) for c in (0, 1))


def bit(sq: str) -> str:
    return f"shiftleft(1L, CAST({sq} AS INT))"


def has(squares: str, sq: str) -> str:
    return f"(({squares}) & {bit(sq)}) <> 0"


def file_of(sq: str) -> str:
    return f"shiftright({sq}, 3)"


def rank_of(sq: str) -> str:
    return f"(({sq}) & 7)"


def side_rank(sq: str, side: str = "side") -> str:
    """Rank as the side counts it."""
    return f"((({sq}) & 7) ^ (7 * {side}))"


def mirror_file(sq: str) -> str:
    return f"least(shiftright({sq}, 3), 7 - shiftright({sq}, 3))"


def distance(a: str, b: str) -> str:
    return f"greatest(abs(shiftright({a}, 3) - shiftright({b}, 3)), abs((({a}) & 7) - (({b}) & 7)))"


def forward(squares: str, side: str) -> str:
    """One step of pawns ahead; nothing leaves the board."""
    return f"(CASE WHEN {side} = 0 THEN shiftleft(({squares}) & {NOT_RANK_8}L, 1) ELSE shiftrightunsigned(({squares}) & {NOT_RANK_1}L, 1) END)"


def pawn_hits(squares: str, side: str) -> str:
    """Squares that pawns attack."""
    return (
        f"(CASE WHEN {side} = 0 THEN shiftrightunsigned(({squares}) & {NOT_A}L & {NOT_RANK_8}L, 7) | shiftleft(({squares}) & {NOT_H}L & {NOT_RANK_8}L, 9)"
        f" ELSE shiftleft(({squares}) & {NOT_H}L & {NOT_RANK_1}L, 7) | shiftrightunsigned(({squares}) & {NOT_A}L & {NOT_RANK_1}L, 9) END)"
    )


def beside(squares: str) -> str:
    """Neighbours on the files left and right."""
    return f"(shiftrightunsigned({squares}, 8) | shiftleft({squares}, 8))"


def file_set(sq: str) -> str:
    return f"shiftleft(255L, CAST(shiftright({sq}, 3) * 8 AS INT))"


def around_files(sq: str) -> str:
    """The file of a square and those beside it."""
    return f"({file_set(sq)} | {beside(file_set(sq))})"


def _by_rank(masks, sq: str) -> str:
    return "array(" + ", ".join(f"{m}L" for m in masks) + f")[{rank_of(sq)}]"


def ahead(sq: str, side: str = "side") -> str:
    """All ranks ahead of a square, as the side looks."""
    above = [_mask(s for s in range(64) if s % 8 > r) for r in range(8)]
    below = [_mask(s for s in range(64) if s % 8 < r) for r in range(8)]
    return f"(CASE WHEN {side} = 0 THEN {_by_rank(above, sq)} ELSE {_by_rank(below, sq)} END)"


def king_zone(sq: str) -> str:
    """3 x 3 squares, moved inside files B to G and ranks 2 to 7."""
    middle = f"(least(greatest({file_of(sq)}, 1), 6) * 8 + least(greatest({rank_of(sq)}, 1), 6))"
    return f"shiftleft(460551L, CAST({middle} - 9 AS INT))"


def ray(start: str, through: str) -> str:
    """All squares from start in the direction of through."""
    df, dr = f"CAST(sign({file_of(through)} - {file_of(start)}) AS INT)", f"CAST(sign({rank_of(through)} - {rank_of(start)}) AS INT)"
    f, r = f"({file_of(start)} + i * {df})", f"({rank_of(start)} + i * {dr})"
    return f"aggregate(sequence(1, 7), 0L, (a, i) -> CASE WHEN {f} BETWEEN 0 AND 7 AND {r} BETWEEN 0 AND 7 THEN a | shiftleft(1L, CAST({f} * 8 + {r} AS INT)) ELSE a END)"
