"""Topic stems and the pattern that finds a word's longest stem in one scan."""
from __future__ import annotations

import re

# --- fixed values: topic stems, 2 to 8 letters decide -----------------------------------
EN_TOPICS = {
    "love": "love heart kiss hold embrace miss darling baby sweet tender forever together soul",
    "separation and loss": "goodbye leaving gone left alone lonely lost missing broken break cry crying tears farewell empt",
    "city and streets": "city street downtown block avenue traffic subway neon pavement rooftop neighborhood boulevard",
    "road and travel": "road highway journey train plane travel miles walk running driving ride destination trip path",
    "night and sleep": "night midnight moon star sleep dream asleep insomnia dark dawn sunrise twilight shadow evening",
    "nature": "sea ocean wave shore river forest mountain field sky rain storm wind snow winter summer autumn sun grass flower leaf",
    "war and struggle": "war enemy battle fight soldier gun fire army weapon hero victory flag struggle survive defend",
    "freedom and rebellion": "free freedom rebel protest rules chains escape run away revolution independent wild",
    "party and dance": "dance dancing party club tonight friends fun music play jump drink celebrate dj beat",
    "inner search": "meaning life fate destiny answer question soul faith hope dream truth find myself reason",
}
# --- end of fixed values ----------------------------------------------------------------

#: topic -> language -> stems; '' serves every language without its own. Other languages are added by the caller.
TOPICS = {topic: {"": stems.split()} for topic, stems in EN_TOPICS.items()}
SHORTEST, LONGEST = 2, 8
#: Characters of a word, as a character class.
LETTERS = "a-zа-яё"


def with_language(language: str, stems: dict[str, list[str]], topics: dict[str, dict[str, list[str]]] = TOPICS) -> dict[str, dict[str, list[str]]]:
    """The topics with the stems of one more language (topic -> stems); topics may be new."""
    names = [*topics, *(t for t in stems if t not in topics)]
    return {t: {**topics.get(t, {}), language: list(stems.get(t, ()))} for t in names}


def usable(stems: list[str], letters: str = LETTERS) -> list[str]:
    """Stems that a word can begin with: of deciding length, all letters."""
    return [s for s in dict.fromkeys(stems) if SHORTEST <= len(s) <= LONGEST and re.fullmatch(f"[{letters}]+", s)]


def prefixes(stems: list[str]) -> str:
    """Pattern of a prefix tree: at a word's start it takes the longest stem, one branch for each letter."""
    tree: dict = {}
    for s in usable(stems):
        node = tree
        for ch in s:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(ch) + pattern(below) for ch, below in node.items() if ch]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return body + ("?" if "" in node else "")
    return pattern(tree)


def found_by(stems: list[str], every: list[str]) -> list[str]:
    """Longest stems (of all topics) that stand for a word with one of these stems: the word begins with it, so its prefix does."""
    own = set(usable(stems))
    return [s for s in usable(every) if any(s[:n] in own for n in range(SHORTEST, len(s) + 1))]
