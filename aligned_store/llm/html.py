"""HTML extraction by a recurrent block labeller.

A page is split into blocks: runs of text between block-level tags. A bidirectional LSTM in numpy reads
the page's whole sequence of blocks, each as the mean of learned vectors of its tag path (tags, classes
and ids) and of its hashed words, with a few numbers, and labels every block as main text or not. It is
trained here, on generated pages of many layouts whose main text is known.

Defined results: null or empty html has empty text. Scripts, styles, templates, comments, svg and the head are
never blocks. The head ends at its end tag, at body, or where something follows that can't stand in it; an svg
also at the next block or HTML element, and a self-closed one is empty; noscript, template, title and foreignObject
without an end tag hide nothing further. Only scripts, styles and comments run to the end of input. A quote in a
tag that is never closed ends with the tag. A page without a block labelled main text has empty text; a block as
likely as not is main text. Repeated rows are extracted each; a null url is carried along; ids may be of any type;
extra columns are ignored. An empty table gives no rows. Pages of any length are read whole, each by itself where
it is long; what is kept of one grows with its tags and text.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches
from .hashing import powers

#: Elements that begin and end blocks.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: What an opening tag ends, if open, up to the nearest of the barriers.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul details".split())
_BARRIER = frozenset("ul ol dl table div section article aside nav header footer main form blockquote td th body fieldset select details".split())
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|template|noscript|head)(?=[\s/>])([^>]*)>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S | re.I)
#: Ends of templates that aren't in comments, scripts or styles.
_TEMPLATE_END = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|(</template)(?=[\s/>])", re.S | re.I)
#: Elements whose content is no text, up to their first end tag; and what may stand in head without ending it.
_HIDDEN = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in ("script", "style", "noscript", "title", "foreignobject", "iframe", "noframes", "noembed")}
#: Elements whose content is text without markup, and whether references stand in it.
_RAW = {"textarea": True, "xmp": False}
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in _RAW}
_IN_HEAD = frozenset("html head title base basefont bgsound link meta script style template noscript".split())
#: What ends an open svg, besides blocks.
_ENDS_SVG = BLOCK | frozenset("b big br code em embed font i img listing meta nobr ruby s small span strike strong sub sup tt u var".split())
#: A tag or comment that the page ends in.
_UNENDED = re.compile(r"<[a-zA-Z/!?]")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
PATHS, WORDS, DIM, HIDDEN, NUMBERS = 256, 256, 12, 12, 5


class Step:
    """An open element: its names, and the path above it. Blocks share their paths, which thus take no more than the tags.

    Under one root, which stands for the page itself, equal paths are one, over several pages too.
    """

    __slots__ = ("above", "below", "mean", "names", "of", "size", "sum", "tag")

    def __init__(self, tag: str = "", names: tuple[str, ...] = (), above: Step | None = None):
        self.tag, self.names, self.above = tag, names, above
        self.size, self.sum, self.mean, self.of = len(names) + (above.size if above else 0), None, None, None
        self.below: dict[tuple[str, ...], Step] = {}

    def enter(self, names: tuple[str, ...]) -> Step:
        if (step := self.below.get(names)) is None:
            step = self.below[names] = Step(names[0], names, self)
        return step

    def path(self) -> list[str]:
        parts, at = [], self
        while at is not None:
            parts.append(at.names)
            at = at.above
        return [n for names in reversed(parts) for n in names]

    def vector(self, table: np.ndarray) -> np.ndarray:
        """The mean of the rows of ``table`` that the path's names have; it and the sums are kept, for that table."""
        if self.mean is not None and self.of is table:
            return self.mean
        todo, at = [], self
        while at is not None and (at.sum is None or at.of is not table):
            todo.append(at)
            at = at.above
        for step in reversed(todo):
            above = 0 if step.above is None else step.above.sum
            step.sum, step.mean, step.of = above + table[_path_buckets(step.names)].sum(0, dtype=np.float64), None, table
        self.mean = self.sum / max(1, self.size)
        return self.mean


class Block:
    __slots__ = ("at", "linked", "text")

    def __init__(self, at: Step, text: str, linked: int):
        self.at, self.text, self.linked = at, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        return tuple(self.at.path())


def blocks(html: str, root: Step | None = None) -> list[Block]:
    """The page's blocks, with white space made single; empty ones are left out. Their paths are under ``root``."""
    root = root or Step()
    out: list[Block] = []
    stack: list[Step] = []
    text: list[str] = []
    anchor, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append(Block(stack[-1] if stack else root, whole, linked))
            text.clear()
        linked = 0

    def add(piece: str, references: bool = True) -> None:
        """Text between tags; a reference is decoded where it stands, so none forms across a tag or comment."""
        nonlocal linked
        text.append(unescape(piece) if references else piece)
        if anchor:
            linked += len(piece)

    found: dict[str, int] = {}

    def after(name: str, at: int) -> int:
        """Where the next end tag of that name ends, or -1."""
        if name not in found or 0 <= found[name] <= at:
            m = (_HIDDEN.get(name) or _RAW_END[name]).search(html, at)
            found[name] = m.end() if m else -1
        return found[name]

    at = template = svg = 0
    head = False
    last = -1  # where the last end of a template is, once one was opened
    inside: dict[str, int] = {}  # elements open in svg
    opened: dict[str, int] = {}  # and in the page
    closing = html.rfind(">") + 1  # no tag ends after it
    while m := _TAG.search(html, at, closing):
        if m.start() > at and not template and not svg and (not head or not html[at : m.start()].isspace()):
            head = False
            add(html[at : m.start()])
        at = m.end()
        if at == closing and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
            at = len(html)
            break
        # a quote that is never closed holds nothing: its tag ends at the next >
        slash, tag, attributes = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        name = (m[1] or tag or "").lower()
        if not name:
            continue
        end, named = bool(slash), m[2] if m[1] else attributes
        empty = named.endswith("/")
        if not end and name in _HIDDEN and not (svg and (empty or name == "title")) and (svg or name != "foreignobject"):
            to = after(name, at)
            if to < 0 and name in ("script", "style"):
                at = len(html)
                break
            if to < 0 and name == "title":
                to = html.find("<", at)
                to = len(html) if to < 0 else to
            if name in BLOCK and not template and not svg and not head:
                flush()
            at = max(at, to)
            continue
        if name == "template":
            if end:
                template = max(0, template - 1) if m.start() < last else 0
            else:
                if last < 0:
                    last = max((x.start() for x in _TEMPLATE_END.finditer(html) if x[2]), default=0)
                template += at <= last
            continue
        if template:
            continue
        if head and (name not in _IN_HEAD if not end else name in ("head", "body", "html", "br")):
            head = False
        if name == "svg":
            svg = max(0, svg - 1) if end else svg + (not empty)
            if not svg:
                inside.clear()
            continue
        if svg:
            if end and inside.get(name):
                inside[name] -= 1
                continue
            if name not in _ENDS_SVG and not (end and name in ("a", "body", "html")):
                inside[name] = inside.get(name, 0) + (not end and not empty)
                continue
            svg = 0
            inside.clear()
        if name == "head":
            head = not end
            continue
        if name in _RAW and not end and (to := after(name, at)) >= 0:
            flush()
            stack.append((stack[-1] if stack else root).enter((name,)))
            add(html[at : html.rindex("</", at, to)], _RAW[name])
            flush()
            stack.pop()
            at = to
        elif name == "br":
            text.append(" ")
        elif name == "a":
            anchor = 0 if end else 1
        elif name in BLOCK:
            flush()
            if end:
                if opened.get(name):
                    while stack:
                        opened[stack[-1].tag] -= 1
                        if stack.pop().tag == name:
                            break
            else:
                ends = _ENDS.get(name) or ({"p"} if name in _ENDS_P else ())
                for k in range(len(stack) - 1, -1, -1) if ends else ():
                    if stack[k].tag in ends:
                        for step in stack[k:]:
                            opened[step.tag] -= 1
                        del stack[k:]
                    elif stack[k].tag in _BARRIER:
                        break
                if name not in _VOID:
                    named = " ".join(filter(None, (x for t in _NAMES.findall(named) for x in t))).lower()
                    stack.append((stack[-1] if stack else root).enter((name, *("." + x for x in _PART.findall(named)))))
                    opened[name] = opened.get(name, 0) + 1
    rest = _UNENDED.split(html[at:], maxsplit=1)[0]
    if rest and not svg and not template and (not head or not rest.isspace()):
        add(rest)
    flush()
    return out


def _word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of texts that have words and no line ends, and how many words each text has."""
    raw = np.frombuffer("\n".join(texts).lower().encode(), np.uint8)
    space = (raw == 32) | (raw == 10)
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    first, last = edge[::2], edge[1::2]
    up, down = powers(max(1 << 20, len(raw)))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        name = (total[last] - total[first]) * down[first]
        name = (name ^ (name >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (name >> np.uint64(40)).astype(np.intp) % WORDS, np.bincount(np.cumsum(raw == 10)[first], minlength=len(texts))


def _path_buckets(path: tuple[str, ...]) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) % PATHS for x in path], np.intp)


def _numbers(page: list[Block], words: np.ndarray) -> np.ndarray:
    n = len(page)
    out = np.ones((n, NUMBERS), np.float32)
    out[:, 0] = np.log1p(words) / 4
    out[:, 1] = [b.linked / len(b.text) for b in page]
    out[:, 2] = [b.text[-1] in ".!?…" for b in page]
    out[:, 3] = np.arange(n) / n
    return out


def shares(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block: shares of path buckets, shares of word buckets, and numbers."""
    path = np.zeros((len(page), PATHS), np.float32)
    for i, b in enumerate(page):
        np.add.at(path[i], _path_buckets(b.path), 1 / max(1, len(b.path)))
    words, count = _word_buckets([b.text for b in page])
    word = np.bincount(np.repeat(np.arange(len(page)), count) * WORDS + words, minlength=len(page) * WORDS).reshape(-1, WORDS) / np.maximum(count, 1)[:, None]
    return path, word.astype(np.float32), _numbers(page, count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[2]).T @ np.ascontiguousarray(b).reshape(-1, b.shape[2])


class Labeller:
    """Embedding means -> bidirectional LSTM -> logistic unit, for padded groups of pages."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = 2 * DIM + NUMBERS
        init = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"path": init(PATHS, DIM) * 8, "word": init(WORDS, DIM) * 8, "out": init(2 * HIDDEN + size, 1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": init(size, 4 * HIDDEN), f"h{d}": init(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, tape: bool = True) -> tuple[np.ndarray, list]:
        """x: pages x blocks x inputs. Backwards reads each page from its last block. The tape is for training."""
        n, t, _ = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, steps = np.zeros((n, t, HIDDEN), np.float32), []
        begin, pre = 0, np.zeros((n, 0, 4 * HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            if not begin <= k < begin + pre.shape[1]:  # the inputs' part, some steps at a time
                begin = k if d == "f" else max(0, k - 255)
                pre = x[:, begin : begin + 256 if d == "f" else k + 1] @ self.w[f"x{d}"] + self.w[f"c{d}"]
            z = pre[:, k - begin] + h @ self.w[f"h{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k : k + 1]
            new = f * c + i * g
            tanh = np.tanh(new)
            if tape:
                steps.append((k, h, c, i, f, o, g, tanh, m))
            c = m * new
            h = m * (o * tanh)
            out[:, k] = h
        return out, steps

    def forward(self, x, mask, tape: bool = True):
        f, b = self._run(x, mask, "f", tape), self._run(x, mask, "b", tape)
        joint = np.concatenate([f[0], b[0], x], 2)
        return _sigmoid(joint @ self.w["out"] + self.w["bias"])[:, :, 0], (x, f, b, joint)

    def gradients(self, path, word, number, mask, y):
        p, (x, f, b, joint) = self.forward(np.concatenate([path @ self.w["path"], word @ self.w["word"], number], 2), mask)
        wrong = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {"out": _outer(joint, wrong), "bias": wrong.sum((0, 1))}
        back = wrong @ self.w["out"].T
        dx = back[:, :, 2 * HIDDEN :].copy()
        for d, (_, steps), part in (("f", f, back[:, :, :HIDDEN]), ("b", b, back[:, :, HIDDEN : 2 * HIDDEN])):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros_like(steps[0][1]), np.zeros_like(steps[0][1])
            gh = np.zeros_like(self.w[f"h{d}"])
            for k, h0, c0, i, fo, o, gg, tanh, m in reversed(steps):
                dh = (dh + part[:, k]) * m
                dc = (dc + dh * o * (1 - tanh**2)) * m
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * fo * (1 - fo), dh * tanh * o * (1 - o), dc * i * (1 - gg**2)], 1)
                dz_all[:, k] = dz
                gh += h0.T @ dz
                dh, dc = dz @ self.w[f"h{d}"].T, dc * fo
            g |= {f"h{d}": gh, f"x{d}": _outer(x, dz_all), f"c{d}": dz_all.sum((0, 1))}
            dx += dz_all @ self.w[f"x{d}"].T
        g["path"] = _outer(path, dx[:, :, :DIM])
        g["word"] = _outer(word, dx[:, :, DIM : 2 * DIM])
        return g

    def vectors(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """What the network reads for each block of each page, at once for all pages."""
        every = [b for p in pages for b in p]
        path = np.zeros((len(every), DIM), np.float32)
        for i, b in enumerate(every):
            path[i] = b.at.vector(self.w["path"])
        words, count = _word_buckets([b.text for b in every])
        word = np.add.reduceat(self.w["word"][words], np.concatenate([[0], np.cumsum(count)[:-1]])) / count[:, None]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
        return [np.concatenate([path[a:b], word[a:b].astype(np.float32), _numbers(p, count[a:b])], 1) for p, a, b in zip(pages, ends, ends[1:], strict=False)]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 6, group: int = 16, rate: float = 0.02, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        seen = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        ready = [(shares(p), np.array(y, np.float32)) for p, y in pages if p]
        t = 0
        for e in range(epochs):
            order = sorted(rng.permutation(len(ready)), key=lambda i: len(ready[i][1]) // 8)
            groups = [order[k : k + group] for k in range(0, len(order), group)]
            for k in rng.permutation(len(groups)):
                some = [ready[i] for i in groups[k]]
                *x, mask = _padded([s[0] for s in some])
                y = np.zeros(mask.shape, np.float32)
                for i, (_, label) in enumerate(some):
                    y[i, : len(label)] = label
                t += 1
                for name, g in self.gradients(*x, mask, y).items():
                    m, v = seen[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.w[name] -= rate * (1 - e / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        return self

    def label(self, pages: list[list[Block]], cells: int = 1 << 13) -> list[np.ndarray]:
        """Whether each block is main text; pages go in groups of like size, of ``cells`` blocks at most or one page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            take = 1
            while take < len(order) and (take + 1) * len(pages[order[-take - 1]]) <= cells and len(pages[order[-1]]) * (take + 1) <= cells:
                take += 1
            some, order = order[-take:], order[:-take]
            p, _ = self.forward(*_padded([(x,) for x in self.vectors([pages[i] for i in some])]), tape=False)
            for k, i in enumerate(some):
                out[i] = p[k, : len(pages[i])] >= 0.5
        return out


def _padded(pages: list[tuple[np.ndarray, ...]]):
    n, t = len(pages), max(len(p[0]) for p in pages)
    out = [np.zeros((n, t, part.shape[1]), np.float32) for part in pages[0]]
    mask = np.zeros((n, t), np.float32)
    for i, parts in enumerate(pages):
        for o, part in zip(out, parts, strict=True):
            o[i, : len(part)] = part
        mask[i, : len(parts[0])] = 1
    return (*out, mask)


def trained(pages: int = 450, seed: int = 17) -> Labeller:
    """The labeller, trained once in a process on generated pages."""
    from .pages import generate

    kept = trained.__dict__.setdefault("kept", {})
    if (pages, seed) not in kept:
        rng = np.random.default_rng(seed)
        some = []
        for _ in range(pages):
            html, main = generate(rng)
            page = blocks(html)
            some.append((page, [int(b.text in main) for b in page]))
        kept[pages, seed] = Labeller().fit(some)
    return kept[pages, seed]


def main_text(page: list[Block], keep: np.ndarray) -> str:
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def extract(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast((labeller or trained()).w)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        own = Labeller()
        own.w = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            root = Step()
            split = [blocks(h or "", root) for h in batch.column(2).to_pylist()]
            texts = [main_text(p, k) for p, k in zip(split, own.label(split), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

        return step

    return map_batches(rows, make, schema)
