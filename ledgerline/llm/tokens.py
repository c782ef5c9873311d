"""Tokenising whole texts with a public tokenizer, word by word from a bounded memory.

Both vocabularies split texts so that no token crosses a single blank or newline between two
visible characters. Texts are cut there and each distinct piece is encoded once by the
tokenizers library; pieces already met by this worker come from memory. Any other white
space stays inside its piece, so the ids are those of the whole text. Where blanks are no
tokens, texts are cut at every blank and newline, which go. Runs of Latin letters
and of punctuation go to the library's model directly, which saves it the normalising. A text
that holds the literal of an added token goes to the library whole, so that the literal
becomes that token's id, as the library does it. Ids are in the byte order of the machine,
little-endian on all that Spark runs on.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces that a worker remembers, and the longest piece it does.
REMEMBERED = 450_000
LONGEST = 32

_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
_PIECES = re.compile(r"[ \n]?\S+")
_CUTS = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Pieces whose inner cut is plain: Latin letters, then ASCII punctuation.
_PLAIN = re.compile(r"([ \n]?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-/:-@\[-`{-~]*)")


def _byte_characters() -> dict[int, int]:
    """Byte-level vocabularies write each byte as one visible character: those that are none start at 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_CHARACTERS = _byte_characters()


class Encoder:
    """Encodes texts to little-endian uint32 bytes."""

    def __init__(self, path: str, plain: bool = False):
        """plain: the literal of an added token is ordinary text, as with encode_special_tokens of the library."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else self.tokenizer.get_added_tokens_decoder().values()
        #: Literals of added tokens; those that are looked for after normalising may be written in either case.
        self.exact = [t.content for t in added if not t.normalized]
        self.folded = [t.content.lower() for t in added if t.normalized]
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        #: Whether blanks are tokens, and whether letters are lower-cased, shows in what it does.
        self.blanks = self._whole("a b") != self._whole("a") + self._whole("b")
        self.lower = self._whole("A") == self._whole("a")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id of a byte-level vocabulary."""
        back = {c: b for b, c in _CHARACTERS.items()}
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        return [bytes(back.get(ord(c), ord(c)) for c in names.get(i, "")) for i in range(max(names) + 1)]

    def _holds_added(self, text: str) -> bool:
        return any(a in text for a in self.exact) or bool(self.folded) and any(a in text.lower() for a in self.folded)

    @staticmethod
    def cut(text: str) -> list[str]:
        pieces = _PIECES.findall(text)
        return pieces if sum(map(len, pieces)) == len(text) else _CUTS.split(text)

    def _pieces(self, text: str) -> list[str]:
        """Pieces to encode. Where blanks and newlines are no tokens and part the words, they go: fewer pieces differ."""
        return self.cut(text) if self.blanks else text.replace("\n", " ").split(" ")

    def _part(self, part: str) -> bytes:
        """Ids of one letter or punctuation run, straight from the model."""
        found = self.parts.get(part)
        if found is None:
            written = (part.lower() if self.lower else part).encode().decode("latin-1").translate(_CHARACTERS)
            found = self.parts[part] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return found

    def _plain(self, piece: str) -> bytes | None:
        m = _PLAIN.fullmatch(piece)
        if not m:
            return None
        lead, letters, tail = m.groups()
        if not self.blanks:
            out = self._part(letters)
        elif lead == "\n":
            out = self._part("\n") + self._part(letters)
        else:
            out = self._part(lead + letters)
        return out + self._part(tail) if tail else out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces that `cut` gave, which hold no literal of an added token; they aren't remembered."""
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        coded = [self._plain(p) for p in pieces]
        odd = [i for i, c in enumerate(coded) if c is None]
        for k in range(0, len(odd), 4096):
            part = odd[k : k + 4096]
            for i, found in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                coded[i] = array("I", found.ids).tobytes()
        return coded

    def encode(self, texts: list[str]) -> list[bytes]:
        special = [self._holds_added(t) for t in texts]
        cut = [[] if whole else self._pieces(t) for t, whole in zip(texts, special, strict=True)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        known = self.known
        odd, met = [], set().union(*cut)
        for piece in met.difference(known):
            coded = self._plain(piece)
            if coded is None:
                odd.append(piece)
            else:
                known[piece] = coded
        for i in range(0, len(odd), 4096):
            part = odd[i : i + 4096]
            for piece, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[piece] = array("I", coded.ids).tobytes()
        out = [self._whole(t) if whole else b"".join(map(known.__getitem__, pieces)) for t, whole, pieces in zip(texts, special, cut, strict=True)]
        for piece in odd:
            if len(piece) > LONGEST:
                del known[piece]
        return out


class PieceEncoder:
    """Encodes pieces of texts by a sentencepiece model that adds a blank in front and has byte fallback.

    A piece starts with the blank that it's joined by or with a newline. No entry of the model
    holds a blank behind another character, or a newline, so no token crosses a cut; models
    that have such entries are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in n or "\u2581" in n.lstrip("\u2581") for n in self.names):
            raise ValueError("entries of the model cross blanks")

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id: U+2581 is a blank, <0xHH> one byte."""
        return [bytes([int(n[3:5], 16)]) if _BYTE.fullmatch(n) else n.replace("\u2581", " ").encode() for n in self.names]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. The model adds the blank; where a newline leads, that blank is taken off again."""
        coded = self.model.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        return [c if p[0] == " " else c[1:] for p, c in zip(pieces, coded, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
