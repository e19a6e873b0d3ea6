"""A small HTML reader: a page as parallel lists of nodes with features for each."""

from __future__ import annotations

import html
import re

import numpy as np

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCT = re.compile(r"[.,;:!?]")
_WHITE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe".split())  # up to their end tag, or to the page's end
HIDDEN = frozenset("svg select template".split())  # nodes whose text is not shown
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot html body head".split())
#: An opening tag ends open ones of these kinds, up to the container named.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}

TAG_GROUPS = [
    {"#text"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "menu", "dl", "dt", "dd"}, {"a"}, {"div"}, {"section"}, {"article", "main"},
    {"nav"}, {"aside"}, {"header"}, {"footer"}, {"form", "button", "label", "fieldset", "input"}, {"table", "tr", "td", "th", "tbody"}, {"blockquote", "pre", "figure", "figcaption"},
]
TOKEN_GROUPS = [
    "article post content entry main story body text page".split(),
    "nav menu navbar navigation breadcrumb breadcrumbs toc tabs".split(),
    "ad ads advert advertisement adverts sponsor sponsored promo promoted promotion banner".split(),
    "comment comments reply replies respond discussion disqus thread reader".split(),
    "sidebar side aside widget related recommended share social sharing tags trending popular".split(),
    "footer foot copyright legal colophon".split(),
    "header masthead topbar logo brand head".split(),
    "cookie cookies consent notice gdpr alert popup modal overlay subscribe newsletter privacy".split(),
    "form login search signup signin contact".split(),
]
_TAG_BITS = {tag: 1 << g for g, tags in enumerate(TAG_GROUPS) for tag in tags}
_TOKEN_BITS = {w: 1 << g for g, words in enumerate(TOKEN_GROUPS) for w in words}
T, K = len(TAG_GROUPS), len(TOKEN_GROUPS)
N_NUMERIC = 14
N_FEATURES = 2 * T + 2 * K + N_NUMERIC


class Page:
    """Nodes in page order: parent, tag and token bits, text (of ``#text`` nodes) and block number."""

    __slots__ = ("parent", "tag", "tags", "tokens", "text", "block")

    def __init__(self, source: str | None):
        self.parent, self.tag, self.tags, self.tokens, self.text, self.block = [-1], ["#root"], [0], [0], [""], [0]
        self._read(source or "")

    def _node(self, parent: int, tag: str, tokens: int, text: str, block: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tags.append(_TAG_BITS.get(tag, 0))
        self.tokens.append(tokens)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1

    def _read(self, s: str) -> None:
        stack, at, block, size = [0], 0, 0, len(s)
        tag_of = self.tag
        hidden = 0  # the place in the stack of the first hidden node, if any
        while at < size:
            m = _MARKUP.search(s, at)
            upto = m.start() if m else size
            if upto > at:
                piece = s[at:upto]
                hidden = hidden if hidden < len(stack) else 0
                if hidden:
                    pass
                elif not piece.isspace():
                    self._node(stack[-1], "#text", 0, piece, block)
                elif self.text[-1] and self.block[-1] == block:
                    self.text[-1] += " "
            if not m:
                break
            at = m.end()
            closing, name, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
            if name is None:
                continue
            name = name.lower()
            if closing:
                if name == "br" or name == "p" and not any(tag_of[i] == "p" for i in stack):
                    block += name == "p"
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tag_of[stack[k]] == name:
                        if any(tag_of[i] in BLOCK for i in stack[k:]):
                            block += 1
                        del stack[k:]
                        break
                continue
            if name in RAW:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(s, at)
                    if end is None:
                        at = size
                    else:
                        close = s.find(">", end.start())
                        at = size if close < 0 else close + 1
                continue
            if name == "br":
                if self.text[-1] and self.block[-1] == block:
                    self.text[-1] += " "
                continue
            if name in BLOCK:
                block += 1
                hidden = hidden if hidden < len(stack) else 0
                if hidden and tag_of[stack[hidden]] != "template":  # a drawing or choice left open ends here
                    del stack[hidden:]
                    hidden = 0
                if name in CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[k]] == "p":
                            del stack[k:]
                            break
                        if tag_of[stack[k]] in BLOCK:
                            break
                if name in CLOSES:
                    kinds, until = CLOSES[name]
                    for k in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[k]] in until:
                            break
                        if tag_of[stack[k]] in kinds:
                            del stack[k:]
                            if name not in ("tr", "tbody", "tfoot"):
                                break
                            break
            if name in VOID:
                continue
            tokens = 0
            if rest:
                for value in _NAMES.findall(rest):
                    for w in _TOKEN.findall(value):
                        tokens |= _TOKEN_BITS.get(w.lower(), 0)
            node = self._node(stack[-1], name, tokens, "", block)
            if not rest.endswith("/"):
                stack.append(node)
                hidden = hidden if 0 < hidden < len(stack) - 1 else len(stack) - 1 if name in HIDDEN else 0

    def features(self) -> np.ndarray:
        """One row of features for each node."""
        n = len(self.tag)
        parent = self.parent
        length, link, tags, punct, paras, kids = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        depth, index, above_tags, above_tokens, same, link_above = [0] * n, [0] * n, [0] * n, [0] * n, {}, [False] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            index[i] = kids[p]
            kids[p] += 1
            above_tags[i] = above_tags[p] | self.tags[p]
            above_tokens[i] = above_tokens[p] | self.tokens[p]
            link_above[i] = link_above[p] or self.tag[i] == "a"
            key = (p, self.tag[i])
            same[key] = same.get(key, 0) + 1
            text = self.text[i]
            if text:
                length[i] = len(text)
                punct[i] = len(_PUNCT.findall(text))
                link[i] = length[i] if link_above[i] else 0
            else:
                tags[i] = 1
                paras[i] = self.tag[i] == "p"
        before, total = [0] * n, 0
        for i in range(n):
            before[i] = total
            total += length[i]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            length[p] += length[i]
            link[p] += link[i]
            tags[p] += tags[i]
            punct[p] += punct[i]
            paras[p] += paras[i]
        par = np.array(parent)
        par[0] = 0
        size = np.array(length, float)
        bits = np.arange(T)
        kbits = np.arange(K)
        siblings = np.array(kids, float)[par]
        out = np.empty((n, N_FEATURES), np.float32)
        out[:, :T] = (np.array(self.tags)[:, None] >> bits) & 1
        out[:, T : 2 * T] = (np.array(above_tags)[:, None] >> bits) & 1
        out[:, 2 * T : 2 * T + K] = (np.array(self.tokens)[:, None] >> kbits) & 1
        out[:, 2 * T + K : 2 * T + 2 * K] = (np.array(above_tokens)[:, None] >> kbits) & 1
        one = np.maximum(size, 1)
        out[:, 2 * T + 2 * K :] = np.stack(
            [
                np.array(depth, float), np.log1p(size), np.array(link, float) / one, size / (1 + np.array(tags, float)), np.array(punct, float) / one,
                np.array(kids, float), np.array(index, float), siblings, np.array([1.0] + [same[parent[i], self.tag[i]] for i in range(1, n)]) / np.maximum(siblings, 1),
                np.array(before, float) / max(1, total), size / max(1, total), size / np.maximum(size[par], 1), np.array(paras, float), np.log1p(size[par]),
            ],
            axis=1,
        )
        return out

    def blocks(self, kept) -> str:
        """The text of the kept ``#text`` nodes: a line for each block that has any."""
        lines: list[str] = []
        now, parts = None, []
        for i, text in enumerate(self.text):
            if text and kept[i]:
                if self.block[i] != now:
                    if parts:
                        lines.append("".join(parts))
                    now, parts = self.block[i], []
                parts.append(text)
        if parts:
            lines.append("".join(parts))
        clean = (_WHITE.sub(" ", html.unescape(x)).strip() for x in lines)
        return "\n".join(x for x in clean if x)
