"""Encoding texts piece by piece with a tokenizer, each piece once.

A text may be cut wherever a character that is no white space is followed by
blank, tab or line end: the pre-tokenizers used here match no run across such a
place, so the ids of a text are those of its pieces, one after the other.  Tokenizers
for which this isn't known are refused when they are loaded.
"""

from __future__ import annotations

import json
import re

# A piece is white space and what follows up to the next white space ...
PIECE = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
# ... and where other white space occurs, cuts need a look at the character before.
RARE_SPACE = re.compile(r"[^\S \t\r\n]")
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")


def split_pieces(text: str) -> list[str]:
    if RARE_SPACE.search(text):
        return [p for p in SAFE_CUT.split(text) if p]
    return PIECE.findall(text)


# Patterns of pre-tokenizers none of whose matches has white space after another character.
SAFE_SPLITS = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"])


class UnknownTokenizer(ValueError):
    """Texts can't be encoded piece by piece with this tokenizer."""


def _parts(part, inner: str) -> list[dict]:
    """Settings of a normalizer or pre-tokenizer, those of a sequence one after the other."""
    if part is None:
        return []
    state = json.loads(part.__getstate__())
    return state[inner] if state["type"] == "Sequence" else [state]


def _refuse_unless(holds: bool, why: str) -> None:
    if not holds:
        raise UnknownTokenizer(f"this tokenizer can't be used piece by piece: {why}")


def drops_space(tokenizer) -> bool:
    """Whether white space gives no ids."""
    return any(x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] for x in _parts(tokenizer.pre_tokenizer, "pretokenizers"))


def check_cuts(tokenizer) -> None:
    """Raise an error unless the ids of a text are known to be those of its pieces."""
    cuts = False
    for x in _parts(tokenizer.pre_tokenizer, "pretokenizers"):
        if x["type"] == "ByteLevel":
            _refuse_unless(not x["add_prefix_space"], "it puts a blank before each text")
            cuts |= x["use_regex"]
        else:
            _refuse_unless(x["type"] == "Split" and x["pattern"].get("Regex") in SAFE_SPLITS, f"pre-tokenizer {x['type']} may match across a cut")
            cuts = True
    _refuse_unless(cuts, "no pre-tokenizer cuts at white space")
    for x in _parts(tokenizer.normalizer, "normalizers"):
        one_blank = x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " and drops_space(tokenizer)
        _refuse_unless(one_blank or x["type"] in ("NFC", "Lowercase"), f"normalizer {x['type']} may depend on what is beyond a cut")
    for x in tokenizer.get_added_tokens_decoder().values():
        _refuse_unless(not (x.lstrip or x.rstrip or x.single_word or re.search(r"\s", x.content)), f"added token {x.content!r} takes in white space or looks at its neighbours")
    _refuse_unless(not getattr(tokenizer.model, "dropout", None), "merges are dropped at random")


def check_decoding(tokenizer) -> None:
    """Raise an error unless decoding pieces one by one gives the whole's text."""
    decoder = json.loads(tokenizer.decoder.__getstate__())["type"] if tokenizer.decoder is not None else None
    _refuse_unless(decoder == "ByteLevel", f"decoder {decoder} may treat a text's start or its words' borders apart")


def check_lowering(tokenizer) -> None:
    """Raise an error unless words may be lower-cased and white space left out before encoding."""
    lowers = any(x["type"] == "Lowercase" for x in _parts(tokenizer.normalizer, "normalizers"))
    _refuse_unless(lowers and drops_space(tokenizer), "it doesn't lower-case, or white space gives ids")


#: What may follow a word of a direct piece: no pattern above takes letters and these into one match.
TAIL = ".,;:!?&*$%#()\"-"
#: Letters that NFC leaves as they are, whatever of them stands beside them, and that have one lower-case form each.
LOWER, UPPER = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"


def direct_pieces(tokenizer) -> tuple[re.Pattern, bool] | None:
    """Pieces of which each part is one match of the pre-tokenizer, so that its ids are those the model itself gives:
    letters (group 1), then perhaps some of ``TAIL`` (group 2), encoded apart; and whether letters are lower-cased.

    For tokenizers that passed ``check_cuts``.  None: an added token may be found in such a piece.
    """
    if any(re.fullmatch(rf"[ {LOWER}{UPPER}{re.escape(TAIL)}]*", x.content) for x in tokenizer.get_added_tokens_decoder().values()):
        return None
    normalizers, steps = _parts(tokenizer.normalizer, "normalizers"), _parts(tokenizer.pre_tokenizer, "pretokenizers")
    # Letters must come to the model as bytes, once, and a blank in front only where the pattern has one.
    kinds = [x["type"] for x in steps]
    if kinds != ["ByteLevel"] and (kinds != ["Split", "ByteLevel"] or steps[1]["use_regex"]):
        return None
    blank = " ?" if len(steps) == 1 and not normalizers else ""
    return re.compile(rf"({blank}[{LOWER}{UPPER}]+)([{re.escape(TAIL)}]*)"), any(x["type"] == "Lowercase" for x in normalizers)


def byte_letters() -> dict[int, str]:
    """What ByteLevel makes of a blank and of the letters of direct pieces that are not ASCII."""
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return {ord(c): level.pre_tokenize_str(c)[0][0] for c in [" ", *map(chr, range(0xC0, 0x100))]}


def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    check_cuts(t)
    return t


#: Pieces that are handed to the tokenizer at once, and those whose values a Python worker keeps.
BATCH, KEPT_PIECES = 2_000, 300_000


class Recent:
    """A mapping of bounded size: when the young half is full the old half is forgotten."""

    def __init__(self, size: int):
        self.half, self.young, self.old = max(1, size // 2), {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class PieceEncoder:
    """What ``finish(ids, tokenizer)`` makes of a piece's ids, kept for the pieces seen last; ``join`` makes
    what two pieces in a row would have given of what each gave.

    Words without anything else in them are handed to the tokenizer's model, the rest to the whole tokenizer.
    One encoder is kept for each tokenizer, purpose and Python worker, so that later tasks
    of the worker find the pieces of earlier ones.
    """

    _kept: dict = {}

    def __init__(self, path: str, finish, join, size: int):
        self.tokenizer, self.finish, self.join, self.cache = load_tokenizer(path), finish, join, Recent(size)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.direct, self.lowers = direct_pieces(self.tokenizer) or (None, False)

    @classmethod
    def shared(cls, path: str, finish, join, size: int = KEPT_PIECES) -> PieceEncoder:
        key = (path, finish.__module__, finish.__qualname__, size)
        if key not in cls._kept:
            cls._kept[key] = cls(path, finish, join, size)
        return cls._kept[key]

    def lookup(self, pieces: set[str]) -> dict:
        """The values of all pieces; those not kept are encoded."""
        found, words, others, tailed, get = {}, set(), set(), [], self.cache.get
        direct = self.direct.fullmatch if self.direct else lambda piece: None
        for p in pieces:
            v = get(p)
            if v is not None:
                found[p] = v
                continue
            m = direct(p)
            if m is None:
                others.add(p)
            elif not m[2]:
                words.add(p)
            else:
                tailed.append((p, m[1], m[2]))
        parts = {}
        for _, word, tail in tailed:
            for part, wanted in ((word, words), (tail, others)):
                if part not in parts:
                    v = found.get(part)
                    parts[part] = get(part) if v is None else v
                    if parts[part] is None:
                        wanted.add(part)
        made = {**self._encode(list(others), self._whole), **self._encode(list(words), self._by_model)}
        parts.update(made)
        for p, word, tail in tailed:
            found[p] = self.join([parts[word], parts[tail]])
            self.cache.put(p, found[p])
        found.update(made)
        return found

    def _encode(self, pieces: list[str], encode) -> dict:
        made = {}
        for at in range(0, len(pieces), BATCH):  # what the library makes of a batch is far larger than its ids
            part = pieces[at : at + BATCH]
            for p, v in zip(part, self.finish(encode(part), self.tokenizer)):
                made[p] = v
                self.cache.put(p, v)
        return made

    def _whole(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _by_model(self, words: list[str]) -> list[list[int]]:
        tokenize, lowers, letters = self.model.tokenize, self.lowers, self.letters
        out = []
        for w in words:
            if lowers:
                w = w.lower()
            if w[0] == " " or not w.isascii():
                w = w.translate(letters)
            out.append([t.id for t in tokenize(w)])
        return out
