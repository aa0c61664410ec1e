"""Pre-tokens of a word-BPE tokenizer file, exactly as its library's normalizer and pre-tokenizer give them.

The plain path covers texts of ASCII, Latin-1 and Latin Extended letters with one compiled pattern; any other
code point sends the text through the library's own normalizer and splitter, so both give the same pieces.
"""

from __future__ import annotations

import json
import re

#: Code points for which the plain pattern provably equals the library's classes.
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e ¡-©«-±´¶-¸»¿-įı-ɏ‐-‧‰-⁞€]*")
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class PreSplitter:
    """split(text) lists pre-tokens; a special token's string inside a text stays one item, being its own key."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(spec)
        library = Tokenizer.from_str(json.dumps({**made, "added_tokens": [], "model": {**made["model"], "vocab": {}, "merges": []}}))  # its rules alone
        self._normalize = library.normalizer.normalize_str
        split = made["pre_tokenizer"]["pretokenizers"][0]
        from tokenizers import Regex

        self._pieces = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), behavior=split["behavior"].lower(), invert=split["invert"]).pre_tokenize_str
        self.specials = {t["content"]: t["id"] for t in made["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def _ordinary(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        return [piece for piece, _ in self._pieces(self._normalize(text))]

    def split(self, text: str | None) -> list[str]:
        """Pre-tokens in order; null and empty texts have none."""
        if not text:
            return []
        if self._special is None or not any(s in text for s in self.specials):
            return self._ordinary(text)
        out: list[str] = []
        for part in self._special.split(text):
            out += [part] if part in self.specials else self._ordinary(part)
        return out
