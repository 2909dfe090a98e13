"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks (text runs between block-level tags).  Each block
is a vector of hashed tag-path tokens (tag names, words of class, id and role), hashed
words, length, punctuation, place and share of links; a numpy bidirectional LSTM reads the whole sequence and labels every block with the
context of the page.  The model is trained here, on generated pages whose layout and labels
are known (``TRAINING_PAGES``, a documented bound); nothing about the corpus is learnt.

Defined cases: null and empty html, and pages without a main block, give an empty text;
unclosed tags end with their container; scripts, styles, comments and the head are not
blocks; a drawing ends where a paragraph or another block starts inside it, and a frame,
template or other silent element without an end tag holds nothing; repeated rows are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 384, 24, 8, 16
TRAINING_PAGES, EPOCHS, SEED = 1500, 9, 7
#: Elements that start and end a block, have no end, or hold no text.
BLOCK = set("address article aside blockquote body button dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul noscript".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = set("script style head title template iframe object svg math canvas".split())
#: Drawings, and the tags that end an open one because they cannot stand in it.
DRAWN = set("svg math".split())
BREAKS_OUT = set("article aside blockquote body div dl footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
#: An opening tag of the first kind ends an open one of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Blocks(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...], tuple[str, ...], int, int]] = []
        self.blocks: list[tuple[tuple[str, ...], str, float]] = []
        self.run: list[str] = []
        self.linked = self.silent = self.links = 0
        self.path: tuple[str, ...] = ()
        # end tags still to come: an element of this kind without one would swallow the page
        low = html.lower()
        self.ends = {tag: low.count("</" + tag) for tag in SILENT}
        self.feed(html)
        self.close()
        self.cut()

    def cut(self):
        words = "".join(self.run).split()
        if words:
            self.blocks.append((self.path, " ".join(words), min(1.0, self.linked / sum(map(len, words)))))
        self.run, self.linked = [], 0

    def settle(self):
        """What holds below the open elements: the path, and whether it is silent or linked."""
        top = self.stack[-1] if self.stack else ("", (), (), 0, 0)
        _, _, self.path, self.silent, self.links = top

    def push(self, tag, tokens):
        self.stack.append((tag, tokens, self.path + tokens, self.silent + (tag in SILENT), self.links + (tag == "a")))
        self.settle()

    def pop_to(self, at: int):
        del self.stack[at:]
        self.settle()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append(" ")
        if tag in BLOCK:
            self.cut()
            ends = ENDS.get(tag, set()) | {"p"}
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] in ends:
                    self.pop_to(at)
                    break
                if self.stack[at][0] in BLOCK:
                    break
        if tag == "body" or tag in BREAKS_OUT and self.silent:
            kept = [s for s in self.stack if s[0] not in SILENT or tag != "body" and s[0] not in DRAWN]
            self.pop_to(0)
            for old in kept:
                self.push(*old[:2])
        if tag in VOID or tag in SILENT and not self.ends[tag]:
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v)
        tokens = (tag, *("." + w for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower())))
        self.push(tag, tokens)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.ends[tag] -= 1
        if tag in BLOCK:
            self.cut()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.pop_to(at)
                return

    def handle_data(self, data):
        if not self.silent:
            self.run.append(data)
            if self.links:
                self.linked += sum(map(len, data.split()))


def leaf_blocks(html: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """[(tag-path tokens, text, share of it inside links)] of a page, in page order."""
    return _Blocks(html or "").blocks


class _Buckets(dict):
    """Hash bucket of each token, remembered."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[token] = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % self.dim
        return value


_PATHS, _WORDS = _Buckets(PATH_DIM), _Buckets(WORD_DIM)


def vectors(blocks):
    import numpy as np

    x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        x[i, [_PATHS[t] for t in path]] = 1
        words = text.split()
        x[i, PATH_DIM:-NUMBERS] = np.bincount([_WORDS[w] for w in words], minlength=WORD_DIM) / len(words)
        x[i, -NUMBERS:] = (np.log1p(len(words)) / 4, text[-1] in ".!?:", "©" in text, i / max(1, len(blocks) - 1), linked, linked > 0.6, min(1.0, len(path) / 12), np.log1p(text.count(",") + text.count(".")) / 2)
    return x


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output; weights in a plain dict of arrays."""

    def __init__(self, seed: int = SEED):
        import numpy as np

        rng = np.random.default_rng(seed)
        width = PATH_DIM + WORD_DIM + NUMBERS
        self.w = {}
        for side in "fb":
            self.w[f"wx{side}"] = (rng.normal(size=(width, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.w[f"wh{side}"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) * 0.15).astype(np.float32)
            self.w[f"b{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        self.w["out"] = (rng.normal(size=2 * HIDDEN) * 0.2).astype(np.float32)
        self.w["bias"] = np.zeros(1, np.float32)

    def _side(self, x, mask, side):
        """One direction over (T, B, width); masked steps carry the state on."""
        import numpy as np

        steps = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c = np.zeros_like(h)
        states, trail = np.zeros((*x.shape[:2], HIDDEN), np.float32), {}
        z_in = x @ self.w[f"wx{side}"] + self.w[f"b{side}"]
        for t in steps:
            z = z_in[t] + h @ self.w[f"wh{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            fresh = f * c + i * g
            tanh = np.tanh(fresh)
            trail[t] = (h, c, i, f, o, g, tanh, m)
            c, h = m * fresh + (1 - m) * c, m * o * tanh + (1 - m) * h
            states[t] = h
        return states, trail, steps

    def probabilities(self, x, mask):
        import numpy as np

        forward, backward = self._side(x, mask, "f"), self._side(x, mask, "b")
        both = np.concatenate([forward[0], backward[0]], axis=2)
        return _sigmoid(both @ self.w["out"] + self.w["bias"]), both, forward, backward

    def gradients(self, x, mask, y):
        import numpy as np

        p, both, forward, backward = self.probabilities(x, mask)
        delta = (p - y) * mask / mask.sum()
        grad = {"out": (both * delta[..., None]).sum((0, 1)), "bias": np.array([delta.sum()], np.float32)}
        d_both = delta[..., None] * self.w["out"]
        for side, (_, trail, steps), d_out in (("f", forward, d_both[..., :HIDDEN]), ("b", backward, d_both[..., HIDDEN:])):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            d_wh = np.zeros_like(self.w[f"wh{side}"])
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in reversed(steps):
                h, c, i, f, o, g, tanh, m = trail[t]
                dh_t = dh + d_out[t]
                d_fresh = m * (dc + dh_t * o * (1 - tanh * tanh))
                dz = np.concatenate([d_fresh * g * i * (1 - i), d_fresh * c * f * (1 - f), m * dh_t * tanh * o * (1 - o), d_fresh * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                d_wh += h.T @ dz
                dc = (1 - m) * dc + d_fresh * f
                dh = (1 - m) * dh_t + dz @ self.w[f"wh{side}"].T
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grad |= {f"wx{side}": x.reshape(-1, x.shape[2]).T @ flat, f"wh{side}": d_wh, f"b{side}": flat.sum(0)}
        return grad

    def label(self, pages, batch: int = 256, cells: int = 60_000):
        """One boolean list per page (a list of vectors); pages of like length share a batch."""
        import numpy as np

        order, out, at = sorted(range(len(pages)), key=lambda k: len(pages[k])), [None] * len(pages), 0
        while at < len(order):
            size = batch
            while size > 1 and size * len(pages[order[min(at + size, len(order)) - 1]]) > cells:
                size //= 2
            chosen = order[at : at + size]
            x, mask = padded([pages[k] for k in chosen])
            p = self.probabilities(x, mask)[0] if len(x) else np.zeros((0, len(chosen)))
            for j, k in enumerate(chosen):
                out[k] = (p[: len(pages[k]), j] >= 0.5).tolist()
            at += size
        return out


def padded(pages):
    import numpy as np

    top = max(map(len, pages), default=0)
    x = np.zeros((top, len(pages), PATH_DIM + WORD_DIM + NUMBERS), np.float32)
    mask = np.zeros((top, len(pages)), np.float32)
    for j, page in enumerate(pages):
        x[: len(page), j] = page
        mask[: len(page), j] = 1
    return x, mask


#: Names of boilerplate, of content and of layout in the generated pages.
ASIDE_NAMES = "nav navbar menu header masthead topbar footer sidebar aside widget ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal comments comment reply discussion respond form login search newsletter subscribe signup related recommended share social breadcrumb pagination pager copyright legal tags meta toolbar disclaimer".split()
MAIN_NAMES = "article main content post story entry body text prose".split()
LAYOUT_NAMES = "page site wrapper container row col columns grid layout inner outer box wrap area item block left right center single news card section list top".split()
ASIDE_TAGS = "nav header footer aside form".split()


def training_page(rng) -> tuple[str, list[bool]]:
    """A generated page and, in page order, whether each of its blocks is main text.

    A part of the pages names neither content nor layout, so that both must be told by
    their words, links, lengths and neighbours.
    """
    labels: list[bool] = []
    stems = [s + e for s in "ba ke li mo ru ta ve zo the an de en la".split() for e in "n r st nd ti on er s".split()]
    neutral = rng.random() < 0.4

    def words(low, high):
        return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def named(*names):
        """A class or id of these words, of nothing that means anything, or none."""
        kind = rng.random()
        if kind < 0.3:
            return ""
        if kind < 0.6 or not names:
            names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 6))) + str(rng.randint(0, 99))]
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["-", " ", "_"]).join(names)}"'

    def layout():
        return named(*rng.sample(LAYOUT_NAMES, rng.randint(1, 2)))

    def leaf(tag, text, main):
        labels.append(main)
        return f"<{tag}>{text}</{tag}>" if rng.random() < 0.93 or tag not in ("p", "li") else f"<{tag}>{text}"

    def links(low, high):
        tag = rng.choice(["li", "li", "li", "div", "p", "td"])
        inner = "".join(leaf(tag, f'<a href="/x">{words(1, rng.choice([2, 2, 5]))}</a>', False) for _ in range(rng.randint(low, high)))
        return f"<ul>{inner}</ul>" if tag == "li" else f"<table><tr>{inner}</tr></table>" if tag == "td" else inner

    def noise():
        name, tag, plain = rng.choice(ASIDE_NAMES), rng.choice(ASIDE_TAGS) if rng.random() < 0.5 else rng.choice(["div", "section", "div", "ul"]), False
        if tag in ("div", "section", "ul") and (neutral or rng.random() < 0.2):
            plain = True  # only what it holds tells it
            attr = layout()
        elif tag in ("div", "section", "ul") or rng.random() < 0.3:
            attr = f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", rng.choice(["-", " "]) + rng.choice(LAYOUT_NAMES)])}"'
        else:
            attr = ""
        kind = rng.random()
        if tag == "ul":
            inner = "".join(leaf("li", f'<a href="/x">{words(1, 2)}</a>', False) for _ in range(rng.randint(1, 7)))
        elif tag == "nav" or kind < 0.35 or plain and kind < 0.8:
            inner = links(1 if tag == "nav" else 2, 7)
        elif tag == "footer" and kind < 0.8 or kind < 0.5 or plain:
            labels.append(False)
            inner = rng.choice(["&copy; ", "&copy; example &middot; ", "&copy; 2020 "] if plain else ["&copy; ", "&copy; example &middot; ", ""]) + words(2, 14) + rng.choice(["", "."])
        elif tag == "form":
            inner = leaf("label", words(1, 3), False) + '<input name="q">' + leaf("button", words(1, 2), False)
        else:
            inner = "".join(leaf(rng.choice(["p", "p", "div", "h3"]), words(2, 40) + rng.choice([".", "", "!"]), False) for _ in range(rng.randint(1, 4)))
        return f"<{tag}{attr}>{inner}</{tag}>"

    def body():
        out = []
        if rng.random() < 0.8:
            out.append(leaf(rng.choice(["h1", "h1", "h2"]), words(2, 10), True))
        sizes = rng.choice([((1, 4), (10, 60), (40, 120)), ((1, 4), (10, 60), (40, 120)), ((5, 15), (10, 30)), ((1, 2), (1, 3), (2, 8))])
        again = words(1, 6) if rng.random() < 0.08 else None  # pages of repeated lines
        unit = "div" if rng.random() < 0.12 else "p"
        for _ in range(rng.randint(1, 9) if rng.random() < 0.8 else rng.randint(10, 45)):
            kind = rng.random()
            if kind < 0.1:
                out.append(noise())
            elif kind < 0.18:
                out.append("<ul>" + "".join(leaf("li", words(2, 12), True) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.24:
                out.append(leaf("h2", words(1, 6), True))
            elif kind < 0.28:
                out.append(f"<blockquote>{leaf('p', words(4, 20) + '.', True)}</blockquote>")
            elif kind < 0.32:
                out.append("<table><tr>" + "".join(leaf("td", words(1, 4), True) for _ in range(3)) + "</tr></table>")
            elif kind < 0.36:
                out.append(leaf(unit, f'{words(5, 20)} <a href="/y">{words(1, 4)}</a> {words(3, 20)}.', True))
            else:
                text = leaf(unit, rng.choice(["", "<b>", "<i>"]) + (again or words(*rng.choice(sizes))) + rng.choice([".", ".", ".", "", " |"]), True)
                out.append(f"<section{layout()}>{text}</section>" if rng.random() < 0.05 else text)
        return "".join(out)

    if rng.random() < 0.06:  # nothing but a paragraph or two
        inner = "".join(leaf("p", words(8, 60) + ".", True) for _ in range(rng.randint(1, 2)))
        return f"<html><body><div{layout()}>{inner}</div></body></html>", labels
    before, shape = "".join(noise() for _ in range(rng.randint(0, 3))), rng.random()
    if neutral:
        kind = rng.random()
        if kind < 0.25:
            main = body()  # straight in what is around it
        elif kind < 0.4:
            side = f"<td{layout()}>{noise()}</td>" if rng.random() < 0.5 else ""
            main = f"<table{layout()}><tr>{side}<td{layout()}>{body()}</td></tr></table>"
        else:
            tag = rng.choice(["div", "div", "div", "section", "article"])
            main = f"<{tag}{layout()}>{body()}" + (f"</{tag}>" if rng.random() < 0.9 else "")
    else:
        tag = "article" if shape < 0.5 else "main" if shape < 0.7 else "div"
        attr = f' class="{rng.choice(MAIN_NAMES)}{rng.choice(["", "-" + rng.choice(MAIN_NAMES + LAYOUT_NAMES)])}"' if tag == "div" or rng.random() < 0.3 else layout()
        main = f"<{tag}{attr}>{body()}" + (f"</{tag}>" if rng.random() < 0.85 else "")
    for _ in range(rng.choice([0, 0, 1, 2])):
        main = f"<div{layout()}>{main}</div>"
    page = before + main + "".join(noise() for _ in range(rng.randint(0, 3)))
    for _ in range(rng.choice([0, 0, 1, 2])):
        page = f"<div{layout()}>{page}</div>"
    return f"<html><head><title>{words(2, 5)}</title><script>var a='<p>';</script></head><body>{page}</body></html>", labels


def train(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Adam over batches of generated pages; the same seed gives the same labeller."""
    import random

    import numpy as np

    rng, model = random.Random(seed), Labeller(seed)
    made = []
    while len(made) < pages:
        html, labels = training_page(rng)
        blocks = leaf_blocks(html)
        if len(blocks) == len(labels) and blocks:
            made.append((vectors(blocks), np.array(labels, np.float32)))
    made.sort(key=lambda p: len(p[0]))
    batches = [made[i : i + 24] for i in range(0, len(made), 24)]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        rng.shuffle(batches)
        for group in batches:
            x, mask = padded([p for p, _ in group])
            y = np.zeros_like(mask)
            for j, (_, labels) in enumerate(group):
                y[: len(labels), j] = labels
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = (model.w[k] - 0.02 * 0.85**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


_TRAINED: dict[tuple[int, int, int], Labeller] = {}


def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller of these settings, trained once per process."""
    if (pages, epochs, seed) not in _TRAINED:
        _TRAINED[pages, epochs, seed] = train(pages, epochs, seed)
    return _TRAINED[pages, epochs, seed]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    weights = (model or trained()).w  # about 100 KB, whatever the corpus

    def run(batches):
        labeller = Labeller.__new__(Labeller)
        labeller.w = weights
        for pdf in batches:
            blocks = [leaf_blocks(h) for h in pdf.html]
            marks = labeller.label([vectors(b) for b in blocks])
            text = [" ".join(t for (_, t, _), main in zip(b, m) if main) for b, m in zip(blocks, marks)]
            yield pd.DataFrame({"page_id": pdf.page_id.astype("Int64"), "url": pdf.url, "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
