"""The public piece vocabulary as a unigram model: pieces, scores, and byte pieces for what no piece covers."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

#: Mark of a space in pieces (fixed value of the format).
SPACE_MARK = "▁"
#: A byte piece costs so much more than the worst piece, so bytes are used only where no piece fits.
BYTE_PENALTY = 10.0
#: Vocabulary files give runs of blanks a score below this, which says nothing of other pieces.
BLANK = -1e6
_SPACE = r"[\x20\x09-\x0D]"
#: Pre-tokens: letters, or other marks, with the space before them; or one white-space character. All that is not ASCII
#: counts as a letter. The pre-tokens of a text joined are the text. ``words_of`` joins those that a piece spans.
PRETOKEN = rf" ?[A-Za-z\x80-\U0010ffff]+| ?[^A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+|{_SPACE}"


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """``ids`` and ``scores`` by piece text; ``endings``: every ending of a piece, with its score if it is a piece;
    ``bytes``: the id of each byte piece; ``sizes``: UTF-8 bytes by id."""

    ids: dict[str, int]
    scores: dict[str, float]
    endings: dict[str, float | None]
    bytes: tuple[int, ...]
    byte_score: float
    longest: int
    sizes: dict[int, int]


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    """Reads a vocabulary file once per process. Control and unknown pieces take no part.

    A piece that holds the space mark stands for text with a space there.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids, by_byte = {}, [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            by_byte[int(model.id_to_piece(i)[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[model.id_to_piece(i).replace(SPACE_MARK, " ")] = i
    scores = {p: float(model.get_score(i)) for p, i in ids.items()}
    worst = min((s for s in scores.values() if s > BLANK), default=0.0)
    endings = {p[i:]: scores.get(p[i:]) for p in scores for i in range(len(p))}
    return Pieces(ids, scores, endings, tuple(by_byte), worst - BYTE_PENALTY, max(map(len, ids), default=1), {i: len(p.encode()) for p, i in ids.items()})


@lru_cache(maxsize=4)
def words_of(path: str) -> Callable[[str], list[str]]:
    """Function that splits a text where no piece of the vocabulary can cross: pre-tokens, joined where pieces join them.

    So the best path of a text is that of its words, one after another.
    """
    pieces, joints = load_pieces(path), {}
    for p in pieces.scores:
        for cut in [m.end() for m in re.finditer(PRETOKEN, p)][:-1]:
            joints.setdefault(p[cut - 1], set()).add(p[cut])
    if not joints:
        return re.compile(PRETOKEN).findall
    some = lambda marks: "[" + "".join(map(re.escape, sorted(marks))) + "]"
    pairs = "|".join(f"(?<={re.escape(a)})(?={some(b)})" for a, b in sorted(joints.items()))
    near = f"(?<={some(joints)})(?={some(set().union(*joints.values()))})"
    return re.compile(f"(?:{PRETOKEN})(?:{near}(?:{pairs})(?:{PRETOKEN}))*").findall


def best_ids(word: str, pieces: Pieces) -> list[int]:
    """Ids of the best path of a word of any length, bytes in full, in time linear in it.

    Equal scores go to fewer pieces, then to the shorter last piece.
    """
    ids, endings = pieces.ids, pieces.endings
    scores, counts, starts = array("d", [0.0]), array("q", [0]), array("q", [0])
    for end in range(1, len(word) + 1):
        start, s = end - 1, pieces.scores.get(word[end - 1])
        n = 1 if s is not None else len(word[start].encode("utf-8", "surrogatepass"))
        score, count = scores[start] + (pieces.byte_score * n if s is None else s), counts[start] + n
        for at in range(end - 2, -1, -1):
            piece = word[at:end]
            if piece not in endings:
                break  # no piece ends so
            s = endings[piece]
            if s is not None:
                new, k = scores[at] + s, counts[at] + 1
                if new > score or new == score and k < count:
                    score, count, start = new, k, at
        scores.append(score)
        counts.append(count)
        starts.append(start)
    spans, end = [], len(word)
    while end:
        spans.append(word[starts[end] : end])
        end = starts[end]
    out = []
    for piece in reversed(spans):
        out += [ids[piece]] if piece in ids else [pieces.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
    return out
