"""Pages: their links and their text as Markdown, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

DROPPED = {"script", "style", "noscript", "template"}
CHROME = {"header", "footer", "nav", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "div", "dl", "dd", "dt", "figure", "form", "main", "ol", "p", "pre", "section", "table", "tr", "ul"}


class _Markdown(HTMLParser):
    """Writes Markdown; remembers where main, article and #content begin and end, so that the best of them can be taken."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, str | None, int]] = []
        self.skip = 0
        self.roots: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self._put("\n")
            return
        a = dict(attrs)
        root = tag if tag in ("main", "article", "body") else "content" if a.get("id") == "content" else None
        if tag == "p":  # an open paragraph ends where the next begins
            self._close("p")
        if tag == "li":
            self._close("li")
        self.open.append((tag, root, len(self.out)))
        if tag in DROPPED or tag in CHROME:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._put("\n* ")
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "a":
            self.open[-1] = (tag, a.get("href"), len(self.out))
            self._put("[")
        elif tag in ("td", "th"):
            self._put(" | ")
        elif tag in BLOCK:
            self._put("\n\n")

    def _close(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for t, root, at in reversed(self.open[k:]):
                    self._end(t, root, at)
                del self.open[k:]
                return
            if self.open[k][0] in BLOCK and tag in ("p", "li") and self.open[k][0] != "p":
                return

    def _end(self, tag, root, at):
        if tag in DROPPED or tag in CHROME:
            self.skip -= 1
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "a":
            self._put(f"]({root})" if root else "]")
        elif tag in BLOCK or re.fullmatch("h[1-6]", tag):
            self._put("\n\n")
        if root and tag != "a":
            self.roots.setdefault(root, "".join(self.out[at:]))

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if not self.skip:
            self._put(re.sub(r"\s+", " ", data))

    def _put(self, text):
        if not self.skip:
            self.out.append(text)

    def finish(self) -> str:
        self.close()
        for t, root, at in reversed(self.open):
            self._end(t, root, at)
        text = next((self.roots[k] for k in ("main", "article", "content", "body") if self.roots.get(k, "").strip()), "".join(self.out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", text))).strip()


def markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    return parser.finish()


@F.arrow_udf(StringType())
def html_to_text(pages: pa.Array) -> pa.Array:
    return pa.array([None if h is None else markdown(h) for h in pages.to_pylist()], pa.string())


_HREF = re.compile(r"""(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def links(html: str, base: str) -> list[str]:
    out = []
    for m in _HREF.finditer(html):
        href = m.group(1) or m.group(2) or m.group(3)
        try:
            url = urljoin(base, href) if href else ""
            if urlsplit(url).scheme in ("http", "https"):
                out.append(url.split("#", 1)[0])
        except ValueError:
            continue
    return out


@F.arrow_udf(ArrayType(StringType()))
def extract_links(html: pa.Array, base: pa.Array) -> pa.Array:
    """Targets of all links, made absolute, without fragments, in order."""
    return pa.array([links(h or "", b or "") for h, b in zip(html.to_pylist(), base.to_pylist())], pa.list_(pa.string()))
