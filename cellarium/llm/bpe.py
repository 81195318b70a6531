"""BPE encoding and decoding by a tokenization automaton.

Two automata are compiled from the merges.

1. Over tokens.  It accepts exactly the token sequences that BPE makes.  It starts as one state with a loop for
   every byte; each merge (a, b) -> ab is compiled in by a gadget: a state's arc for a leads from then
   on to a copy of its target without the arc for b, and every state from which a then
   b could be read gets an arc for ab to where b led.  The state behind an arc is
   thereby settled by the arc's token, and the gadgets give, for a state t and a token
   u, when the arc (t, u) came into being and when it was taken away:

   * byte states have arcs for all bytes from time 0;
   * the gadget of u = (u1, u2) at time r gives state t an arc for u if t then has u1;
   * the gadget of t = (t1, t2) makes state t a copy of state t2 of that time;
   * the gadget of (t, u) takes the arc (t, u) away.

   Time is the rank of the merge.  A table of 50,000 states with up to 50,000 arcs each has no room in a worker:
   the gadgets themselves are the table, and an arc is read off them.
2. Over bytes.  Since BPE makes one sequence of every prefix of a word, a prefix has one last token.  A state is the
   node that the prefix has in the Aho-Corasick automaton of the tokens' bytes, together with the last tokens before the
   places where, by that node, a token may have begun that goes on.  The next byte gives the next node; of the tokens that end
   there exactly one has an arc from the last token of what stands before it, and that is the last
   token of the longer prefix.  The transition is deterministic and goes into a table, where all words that come by find it.

A word is encoded by one walk over its bytes in that table, without search or steps back; its
tokens are the arc labels, read from the end: the last token, then the last token of what is before it.
Words that come again are read from a bounded table.  Decoding emits the arc labels, too: the bytes of each token.

Texts are split into words by the pattern of the vocabulary; its added tokens are
cut out first, as the tokenizers library does.

Cases: null texts are empty and give no token; words of any length take memory in
proportion to the word; a byte that the vocabulary lacks gives no token and ends what can follow it;
invalid UTF-8 can't occur in a Spark string column.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cellarium.llm.common import bounded_batches, documents, worker_cache

#: Words whose tokens a worker keeps; arcs over tokens, and states over bytes: full tables are begun anew.
KEPT_WORDS = 450_000
KEPT_ARCS = 300_000
KEPT_STATES = 300_000
#: Longer words are not kept.
KEPT_LENGTH = 64

#: Fixed value: the pattern by which the byte-level pre-tokenizer splits.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space or line feed beside other white space, or a line feed at an end; such texts are split by the pattern alone.
BY_WHITE = regex.compile(r"[ \n][\s\x1c-\x1f]|[\s\x1c-\x1f][ \n]|^\n|\n$", regex.V0)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled gadgets, and the transition table over bytes."""

    def __init__(self, vocabulary: str, tables: float = 1.0):
        """``vocabulary``: the JSON of a byte-level BPE tokenizer; ``tables``: the share of the tables' full sizes that a worker has room for."""
        self.kept_words, self.kept_arcs, self.kept_states = (max(1, int(n * tables)) for n in (KEPT_WORDS, KEPT_ARCS, KEPT_STATES))
        spec = json.loads(vocabulary)
        model, letters = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer or prefix space is compiled")
        ids: dict[str, int] = model["vocab"]
        self.label = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.token = {label: i for i, label in self.label.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"], 1):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = ids[left], ids[right], ids[left + right]
            self.gadget[a, b] = r
            if ab not in self.rank:
                self.rank[ab], self.parts[ab] = r, (a, b)
        added = sorted(spec.get("added_tokens", []), key=lambda x: -len(x["content"]))
        self.added = {x["content"]: x["id"] for x in added}
        self.label |= {x["id"]: x["content"].encode() for x in added}
        self.cut = regex.compile("|".join(map(regex.escape, self.added))) if added else None
        self.words = regex.compile(PATTERN)
        self.arcs: dict[int, bool] = {}
        self.token = {label: i for label, i in self.token.items() if self._sound(i)}
        self._compile_bytes()
        self._begin_states()
        self.first: dict[str, str] = {}
        self.after_space: dict[str, str] = {}

    def has_arc(self, t: int, u: int) -> bool:
        """Whether state t has an arc for token u after the last gadget."""
        key = t << 20 | u
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= self.kept_arcs:
                self.arcs.clear()
            found = self.arcs[key] = self._arc_before(t, u, len(self.gadget) + 1)
        return found

    def _arc_before(self, t: int, u: int, time: int) -> bool:
        """Whether the arc was there before the gadget of ``time``; both tokens are older than that."""
        while True:
            taken = self.gadget.get((t, u))
            if taken is not None and taken < time:
                return False
            came_t, came_u = self.rank.get(t, 0), self.rank.get(u, 0)
            if not came_t and not came_u:
                return True
            if came_t >= came_u:
                # The later of the two was made by its gadget: state t as a copy of its right part's state.
                # A gadget of the same token twice, as in aaa, gives the new state the old one's arcs and its own.
                if came_t == came_u:
                    t, u, time = self.parts[t][1], self.parts[u][0], came_t
                else:
                    t, time = self.parts[t][1], came_t
            else:
                # The arc for u: only where the left part's arc outlived the gadget's own cut.
                t, u, time = t, self.parts[u][0], came_u + 1

    def _compile_bytes(self) -> None:
        """The Aho-Corasick automaton of the tokens: children and failure of each node, its depth, its own token, and the next node with one."""
        child: list[dict[int, int]] = [{}]
        own, depth = [-1], [0]
        for label, u in self.token.items():
            node = 0
            for byte in label:
                below = child[node].get(byte)
                if below is None:
                    below = child[node][byte] = len(child)
                    child.append({})
                    own.append(-1)
                    depth.append(depth[node] + 1)
                node = below
            own[node] = u
        fail, shorter = [0] * len(child), [0] * len(child)
        queue = deque(child[0].values())
        while queue:
            node = queue.popleft()
            for byte, below in child[node].items():
                other = fail[node]
                while other and byte not in child[other]:
                    other = fail[other]
                fail[below] = child[other].get(byte, 0)
                queue.append(below)
            shorter[node] = fail[node] if own[fail[node]] >= 0 else shorter[fail[node]]
        self.child, self.fail, self.depth, self.own, self.shorter = child, fail, depth, own, shorter
        self.begun: list[tuple[int, ...] | None] = [None] * len(child)
        self.size = {u: len(label) for u, label in self.label.items()}
        self.label_of_name = {str(u): label for u, label in self.label.items()}

    def _begin_states(self) -> None:
        """State 0 is the empty prefix.  ``lasts[s]`` has the last token before each place where a longer token may have begun, -1 before the first byte."""
        self.steps: dict[int, int] = {}
        self.states: dict[tuple[int, ...], int] = {(0, -1, -1): 0}
        self.node: list[int] = [0]
        self.lasts: list[tuple[int, ...]] = [(-1,)]
        self.last: list[int] = [-1]

    def _begun(self, node: int) -> tuple[int, ...]:
        """How many bytes back a token that goes on may have begun, if the prefix has this node: the depths of the failures that have children."""
        found = self.begun[node]
        if found is None:
            own = (self.depth[node],) if self.child[node] or not node else ()
            found = self.begun[node] = own + (self._begun(self.fail[node]) if node else ())
        return found

    def _step(self, state: int, byte: int) -> int:
        """The transition that the table lacks."""
        node, child, fail = self.node[state], self.child, self.fail
        before = dict(zip(self._begun(node), self.lasts[state], strict=True))
        while node and byte not in child[node]:
            node = fail[node]
        node = child[node].get(byte, 0)
        has_arc, depth = self.has_arc, self.depth
        at, last = (node if self.own[node] >= 0 else self.shorter[node]), -2
        while at:
            # The prefix before the token is as many steps back as the token has bytes.
            u, t = self.own[at], before[depth[at] - 1]
            if t == -1 or (t >= 0 and has_arc(t, u)):
                last = u
                break
            at = self.shorter[at]
        lasts = tuple([before[d - 1] if d else last for d in self._begun(node)])
        key = (node, last, *lasts)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.node)
            self.node.append(node)
            self.lasts.append(lasts)
            self.last.append(last)
        self.steps[state << 8 | byte] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        if len(self.node) >= self.kept_states:
            self._begin_states()
        state, found, path = 0, self.steps.get, []
        add = path.append
        for byte in word:
            below = found(state << 8 | byte)
            state = self._step(state, byte) if below is None else below
            add(state)
        out, at, size, last = [], len(word), self.size, self.last
        while at > 0:
            u = last[path[at - 1]]
            if u < 0:
                at -= 1
                continue
            out.append(u)
            at -= size[u]
        out.reverse()
        return out

    def _sound(self, u: int) -> bool:
        """Whether any state ever gets an arc for u: its parts could follow each other when it was made."""
        parts = self.parts.get(u)
        if parts is None:
            return len(self.label[u]) == 1
        key = -1 - u
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self._sound(parts[0]) and self._sound(parts[1]) and self._arc_before(*parts, self.rank[u])
        return found

    def encode(self, text: str) -> list[str]:
        """The ids of the text, as strings of one or more decimal ids joined by commas."""
        if self.cut is None or self.cut.search(text) is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(str(self.added[m.group()]))
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        """A single space or line feed between other characters always begins a word, or is one; text is cut there first."""
        if BY_WHITE.search(text):
            return self._words(text)
        out: list[str] = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self._kept_word("\n"))
            pieces = line.split(" ")
            if pieces[0]:
                out.append(self._chunk(pieces[0], self.first, ""))
            known = self.after_space
            try:
                out += [known[x] for x in pieces[1:]]
            except KeyError:
                out += [self._chunk(x, known, " ") for x in pieces[1:]]
        return out

    def _chunk(self, piece: str, kept: dict[str, str], before: str) -> str:
        ids = kept.get(piece)
        if ids is None:
            ids = ",".join(self._words(before + piece))
            if len(piece) <= KEPT_LENGTH:
                if len(kept) >= self.kept_words:
                    kept.clear()
                kept[piece] = ids
        return ids

    def _words(self, text: str) -> list[str]:
        return [self._kept_word(w) for w in self.words.findall(text)]

    def _kept_word(self, word: str) -> str:
        """A word with a space before it is kept with the pieces that follow a space, any other with those that don't: a piece of one word is that word."""
        kept, key = (self.after_space, word[1:]) if word[0] == " " else (self.first, word)
        ids = kept.get(key)
        if ids is None:
            ids = ",".join(map(str, self.encode_word(word.encode())))
            if len(key) <= KEPT_LENGTH:
                if len(kept) >= self.kept_words:
                    kept.clear()
                kept[key] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")

    def decode_names(self, ids: list[str]) -> str:
        """The text of decimal ids."""
        return b"".join(map(self.label_of_name.__getitem__, ids)).decode("utf-8", "replace")


def automaton(vocabulary: str, tables: float = 1.0) -> Automaton:
    """The automaton of the vocabulary, compiled once in a worker."""
    cache = worker_cache("bpe")
    key = (hashlib.sha256(vocabulary.encode()).digest(), tables)
    if key not in cache:
        cache[key] = Automaton(vocabulary, tables)
    return cache[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True, tables: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every whole text.

    ``vocabulary`` is a path on the driver; executors get its content as a broadcast (of a few MB,
    whatever the input).  Every text is decoded again from its ids.  ``tables``: see ``Automaton``; it changes memory and time, not results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or default_vocabulary()
    with open(path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(content.value, tables)
        for batch in batches:
            counts, digests, decoded, all_ids = [], [], [], []
            for value in batch.column(1):
                joined = ",".join(machine.encode(value.as_py() or ""))
                ids = joined.split(",") if joined else []
                counts.append(len(ids))
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(machine.decode_names(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(pa.array(list(map(int, ids)), pa.int32()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array([0, *_running(counts)], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(doc_id, text).mapInArrow(run, schema)


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), with_ids=False)


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
