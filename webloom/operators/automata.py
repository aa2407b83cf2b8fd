"""Automata over many patterns at once: path rules with wildcards, and substrings."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of sets that a matcher keeps before it starts anew.
KEPT_STATES = 20_000


class PathRules:
    """Rules of one site as one automaton: a prefix tree over their characters, in which '*' is a node that stays. ``match`` reads a path once, whatever the number of
    rules; sets of nodes seen before are looked up, as in a deterministic automaton that is built while it is used.

    A rule is (allow, pattern): '*' stands for any characters, a final '$' for the end, all else for itself, from the path's start. Of the rules that match, the
    one with the longest pattern decides; on a tie 'allow', then the greater pattern."""

    def __init__(self, rules: list[tuple[int, str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.star: list[int] = [-1]  # the '*' node below a node
        self.stays: list[bool] = [False]
        self.here: list[tuple | None] = [None]  # the best rule that matches once its node is reached
        self.at_end: list[tuple | None] = [None]  # the best one that matches if the path ends there
        for allow, pattern in rules:
            ends = pattern.endswith("$")
            node = 0
            for c in pattern[:-1] if ends else pattern:
                node = self._step(node, c)
            rank, marks = (len(pattern), allow, pattern), self.at_end if ends else self.here
            marks[node] = max(filter(None, (marks[node], rank)))
        self._forget()

    def _step(self, node: int, c: str) -> int:
        """The node after ``c``, made where it is not there; several '*' in a row are one."""
        if c == "*":
            if self.stays[node]:
                return node
            found = self.star[node]
        else:
            found = self.next[node].get(c, -1)
        if found < 0:
            found = len(self.next)
            self.next.append({})
            self.star.append(-1)
            self.stays.append(c == "*")
            self.here.append(None)
            self.at_end.append(None)
            if c == "*":
                self.star[node] = found
            else:
                self.next[node][c] = found
        return found

    def _forget(self) -> None:
        self.sets: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.best: list[tuple | None] = []
        self.start = self._set([0])

    def _set(self, nodes: list[int]) -> int:
        """Number of the set of these nodes and the '*' nodes below them."""
        every = set(nodes)
        for n in nodes:
            if self.star[n] >= 0:
                every.add(self.star[n])
        key = tuple(sorted(every))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.best.append(max((self.here[n] for n in key if self.here[n]), default=None))
        return found

    def match(self, path: str) -> tuple[int, int, str] | None:
        """(length, allow, pattern) of the rule that decides on a path; None where none matches."""
        if len(self.sets) > KEPT_STATES:
            self._forget()
        state = self.start
        found = self.best[state]
        for c in path:
            after = self.moves[state].get(c)
            if after is None:
                nodes = [n for n in self.sets[state] if self.stays[n]]
                nodes += [self.next[n][c] for n in self.sets[state] if c in self.next[n]]
                after = self.moves[state][c] = self._set(nodes)
            state = after
            best = self.best[state]
            if best and (found is None or best > found):
                found = best
            if not self.sets[state]:
                return found
        return max((x for x in (found, *(self.at_end[n] for n in self.sets[state])) if x), default=None)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("next", "star", "stays", "here", "at_end")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()


def pack_rules(rules: list[tuple[int, str]]) -> bytes:
    """An automaton as bytes, for a column."""
    return pickle.dumps(PathRules(rules))


class Substrings:
    """Which of many substrings a text has, in one scan of the text."""

    def __init__(self, words: list[str]) -> None:
        import ahocorasick

        numbers: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            numbers.setdefault(w, []).append(k)
        self.always = sorted(numbers.pop("", []))
        self.automaton = ahocorasick.Automaton()
        for w, ks in numbers.items():
            self.automaton.add_word(w, ks)
        self.any = bool(numbers)
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[int]:
        """Numbers of the words that the text has, ascending; a null has none, and every text has the empty word."""
        if text is None:
            return []
        found = set(self.always)
        if self.any:
            for _, ks in self.automaton.iter(text):
                found.update(ks)
        return sorted(found)


def substrings(text: Column, words: list[str]) -> Column:
    """Array of the numbers of those ``words`` that a text has, ascending. The automaton is built once a worker; a text is scanned once, whatever the number of words."""

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Substrings(words)
        for batch in batches:
            yield batch.map(automaton.find, na_action=None)

    return find(text)
