"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The library pops the best-scored neighbouring pair of a text (ties: leftmost) until no pair forms a piece.  No piece holds a
space marker after another character, so the words of a text are independent; each distinct word of a batch is encoded once.
All words of a batch lie in flat numpy symbol arrays.  A round finds each word's smallest pair rank by a segmented minimum,
merges there, drops finished words and compacts, until no pair remains.  All leftmost occurrences of a word's best pair merge at
once where that equals popping them one by one: if no longer piece that begins or ends with the merged one has a score as good.
Else only the leftmost merges in that round.

Such rounds walk through a word once for each merge, which is quadratic in a word of very many characters.  The few words over
:data:`LONG_WORD` characters are therefore merged pair by pair in the library's own order, from one heap, in time that grows with
their length.
"""
from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.iinfo(np.int32).max
#: Words kept between batches in a Python worker, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 1_500_000, 40
#: Characters from which a word is merged from a heap.
LONG_WORD = 2048


class PieceModel:
    """A BPE model file with the identity normaliser, dummy prefix and byte fallback; others are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if (train.model_type != schema.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or not train.byte_fallback or train.treat_whitespace_as_suffix or not kinds <= {1, 2, 3, 6}):
            raise ValueError("only BPE models with identity normaliser, dummy prefix, byte fallback and plain pieces are supported")
        self.size = len(proto.pieces)
        self.bos, self.eos = train.bos_id, train.eos_id
        pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans two words")
        self.bytes_at = np.full(256, -1, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes_at[int(p.piece[3:5], 16)] = i
        symbol = dict(pieces)
        for p in pieces:
            for c in p:
                symbol.setdefault(c, len(symbol) + self.size)
        chars = sorted((ord(s), i) for s, i in symbol.items() if len(s) == 1)
        self.unknown = max(symbol.values()) + 1  # a character that no piece holds: unknown + its code
        self.char_symbol = np.arange(0x110000, dtype=np.int32) + self.unknown
        self.char_symbol[[c for c, _ in chars]] = [i for _, i in chars]
        self.char_of = {i: c for c, i in chars}
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs, unsafe = [], set()
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is None or b is None:
                    continue
                pairs.append((a, b, levels[score[p]], i))
                unsafe.update(x for x in (p[:k], p[k:]) if len(x) > 1 and score[x] <= score[p])
        self.width = self.unknown + 1
        pairs.sort()
        self.pair_key = np.array([a * self.width + b for a, b, _, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, _, r, _ in pairs], np.int32)
        self.pair_piece = np.array([i for _, _, _, i in pairs], np.int32)
        self.unsafe = np.zeros(self.width, bool)
        self.unsafe[[pieces[p] for p in unsafe]] = True
        text = [{1: lambda: p.piece.replace(MARK, " ").encode(), 2: lambda: train.unk_surface.encode(), 3: bytes, 6: lambda: bytes([int(p.piece[3:5], 16)])}[p.type]() for p in proto.pieces]
        self.kind = np.array([p.type for p in proto.pieces], np.int8)
        self.starts_marked = np.array([p.type == 1 and p.piece.startswith(MARK) for p in proto.pieces])
        self.text_len = np.array([len(t) for t in text], np.int64)
        self.text_at = np.concatenate([[0], np.cumsum(self.text_len)[:-1]])
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.pair_at: dict[int, tuple[int, int]] | None = None
        self.cache: dict[str, bytes] = {}

    # -- encoding

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.minimum(left, self.unknown).astype(np.int64) * self.width + np.minimum(right, self.unknown)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], _NONE), np.where(hit, self.pair_piece[at], -1)

    def _merged(self, sym: np.ndarray) -> np.ndarray:
        """Symbols of one long word after all its merges."""
        if self.pair_at is None:
            self.pair_at = dict(zip(self.pair_key.tolist(), zip(self.pair_rank.tolist(), self.pair_piece.tolist())))
        pair_at, width, n = self.pair_at, self.width, len(sym)
        rank, _ = self._ranks(sym[:-1], sym[1:])
        at = np.flatnonzero(rank != _NONE)
        agenda = np.sort(rank[at].astype(np.int64) * n + at).tolist()  # sorted, so a heap
        plain = np.minimum(sym, self.unknown).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while agenda:
            best, i = divmod(heapq.heappop(agenda), n)
            j = after[i]
            if plain[i] < 0 or j >= n:
                continue
            found = pair_at.get(plain[i] * width + plain[j])
            if found is None or found[0] != best:
                continue  # the pair has changed since
            plain[i], plain[j] = found[1], -1
            after[i] = k = after[j]
            before[k] = i
            if k < n and (new := pair_at.get(found[1] * width + plain[k])):
                heapq.heappush(agenda, new[0] * n + i)
            h = before[i]
            if h >= 0 and (new := pair_at.get(plain[h] * width + found[1])):
                heapq.heappush(agenda, new[0] * n + h)
        left = np.array(plain, np.int64)
        return np.where(left == self.unknown, sym, left)[left >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers; a word starts with the space marker and holds it nowhere after another character."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym = self.char_symbol[code]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        done_sym, done_word = [], []
        for k in np.flatnonzero(lens > LONG_WORD):
            done_sym.append(self._merged(sym[word == k]).astype(np.int32))
            done_word.append(np.full(len(done_sym[-1]), k, np.int32))
        if done_sym:
            short = lens[word] <= LONG_WORD
            sym, word = sym[short], word[short]
        rank = np.full(len(sym), _NONE, np.int32)
        piece = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            rank[:-1], piece[:-1] = self._ranks(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = _NONE
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(sym)])
            if (best == _NONE).any():
                over = np.repeat(best == _NONE, sizes)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, piece = sym[~over], word[~over], rank[~over], piece[~over]
                continue
            here = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = word[here]
            lead = np.r_[True, owner[1:] != owner[:-1]]
            run_start = np.r_[True, (here[1:] != here[:-1] + 1)] | lead
            odd = (np.arange(len(here)) - np.maximum.accumulate(np.where(run_start, np.arange(len(here)), 0))) % 2 == 1
            here = here[np.where(self.unsafe[piece[here]], lead, ~odd)]
            sym[here] = piece[here]
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            new_at = np.cumsum(keep) - 1
            sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
            merged = new_at[here]
            touched = np.zeros(len(sym), bool)
            touched[merged] = True
            touched[np.maximum(merged - 1, 0)] = True
            rank[touched] = _NONE
            inner = np.flatnonzero(touched[:-1] & (word[:-1] == word[1:]))
            rank[inner], piece[inner] = self._ranks(sym[inner], sym[inner + 1])
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        odd = sym >= self.size
        if odd.any():  # characters that are no pieces: their UTF-8 bytes
            plain = self.char_of
            out, own = [], []
            for s, w, o in zip(sym.tolist(), word.tolist(), odd.tolist()):
                ids = self.bytes_at[list(chr(plain[s] if s in plain else s - self.unknown).encode())].tolist() if o else [s]
                out += ids
                own += [w] * len(ids)
            sym, word = np.array(out, np.int64), np.array(own, np.int64)
        flat = sym.astype("<u4").tobytes()
        ends = (np.searchsorted(word, np.arange(len(words)), side="right") * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers, with begin and end ids; NULL counts as empty."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        keyed, fresh = [], set()
        for t in texts:
            if not t:
                keyed.append([])
                continue
            if t[0] != " " and "  " not in t and MARK not in t:
                keys = t.split(" ")
            else:
                keys = [w[1:] for w in _WORDS.findall(MARK + t.replace(" ", MARK))]
            keyed.append(keys)
            fresh |= set(keys).difference(cache)
        words = sorted(fresh)
        cache.update(zip(words, self.encode_words([MARK + w for w in words])))
        head, tail = (np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (self.bos, self.eos))
        out = [head + b"".join(map(cache.__getitem__, keys)) + tail for keys in keyed]
        for w in words:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out

    # -- decoding

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of consecutive id sequences of the given lengths."""
        ids = ids.astype(np.int64)
        size = self.text_len[ids]
        begin = np.r_[0, np.cumsum(size)]
        shift = np.repeat(self.text_at[ids] - begin[:-1], size)
        data = self.text_bytes[shift + np.arange(len(shift))].tobytes()
        out, at = [], 0
        for n in lengths.tolist():
            own = ids[at : at + n]
            real = np.flatnonzero(self.kind[own[:8]] != 3)
            real = real if len(real) or n <= 8 else np.flatnonzero(self.kind[own] != 3)
            strip = int(len(real) > 0 and self.starts_marked[own[real[0]]])
            raw = data[begin[at] : begin[at + n]]
            try:
                out.append(raw[strip:].decode())
            except UnicodeDecodeError:
                out.append(self._decode_loose(own)[strip:])
            at += n
        return out

    def _decode_loose(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become U+FFFD, one for each byte."""
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.kind[i] == 6:
                run += self.text_bytes[self.text_at[i] : self.text_at[i] + 1].tobytes()
                continue
            while run:
                n = next((k for k in (1, 2, 3, 4) if _valid(run[:k])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[max(n, 1) :]
            if i >= 0:
                out.append(self.text_bytes[self.text_at[i] : self.text_at[i] + self.text_len[i]].tobytes().decode())
        return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each Python worker."""
    return PieceModel(path)
