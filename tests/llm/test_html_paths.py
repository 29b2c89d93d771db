"""Tag-path ratios against a second, naive implementation over page trees, and pages that are broken."""

import random
import time

import pytest
from ramify.llm import html_extract as h

WORDS = "stone river, winter. people; house small: always together! answer? fields of grain".split()


def tree(draw, depth=0):
    """A random element: (tag, class, children), where a child is an element or a text."""
    kind = draw.choice(["div", "section", "article", "ul", "p", "p", "h2", "blockquote", "nav", "aside"]) if depth else "body"
    name = draw.choice(["", "", "post", "lead", "sidebar", "advert"]) if kind in ("div", "section", "p") else ""
    if kind in ("p", "h2"):
        return kind, name, [" ".join(draw.choice(WORDS) for _ in range(draw.choice([1, 3, 20, 60])))]
    own = [tree(draw, depth + 1) for _ in range(draw.randint(1, 4))] if depth < 4 else ["some words here, in the end."]
    if kind == "ul":
        own = [("li", "", [" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 5)))]) for _ in range(draw.randint(1, 5))]
    return kind, name, own


def render(node):
    tag, name, own = node
    inner = "".join(x if isinstance(x, str) else render(x) for x in own)
    return f"<{tag} class='{name}'>{inner}</{tag}>" if name else f"<{tag}>{inner}</{tag}>"


def naive_text(page):
    """The same rules, spelled out: every pair of paths, every element, every block."""
    found = []  # (path, chain of element ids, furniture, in article, text)

    def walk(node, path, chain, furniture, article):
        tag, name, own = node
        furniture, marked = furniture or tag in ("nav", "aside"), name in ("sidebar", "advert")
        article = not furniture and (article and not marked or tag == "article")
        path, chain = (*path, (tag, name, furniture, article, marked)), (*chain, len(ids))
        ids.append(tag)
        for x in own:
            if isinstance(x, str):
                found.append((path, chain, furniture, article, x))
            else:
                walk(x, path, chain, furniture, article)

    ids = []
    walk(page, (), (), False, False)
    marks = lambda x: sum(c in ".,;:!?" for c in x)
    fused = lambda chars, n: (chars * (1 + n)) ** 0.5
    factor = lambda p: h.MARKED ** sum(step[4] for step in p)
    paths = {f[0] for f in found}
    ratio = {}
    for p in paths:
        own = [f[4] for f in found if f[0] == p]
        ratio[p] = 0.0 if p[-1][2] else factor(p) * fused(sum(map(len, own)) / len(own), sum(map(marks, own)) / len(own))

    def handed(q, up_to):
        """What is left of a path's ratio at the ancestor that is ``up_to`` steps from the root."""
        left = ratio[q]
        for k in range(len(q), up_to, -1):
            above = k > 1 and q[k - 2][3]
            left *= 1 if above else h.DECAY**2 if q[k - 1][3] else h.DECAY
        return left

    def common(p, q):
        k = 0
        while k < min(len(p), len(q)) and p[k] == q[k]:
            k += 1
        return k

    def reaches(q, p):
        """Whether no marked element begins on the way between two paths."""
        k = common(p, q)
        return not any(step[4] for step in (*p[k:], *q[k:]))

    smooth = {p: ratio[p] if p[-1][2] else max(handed(q, common(p, q)) for q in paths if reaches(q, p)) for p in paths}
    weights = [0 if f[2] else factor(f[0]) * len(f[4]) for f in found]
    if not sum(weights):
        return ""
    bound = h.THRESHOLD * sum(w * ratio[f[0]] for w, f in zip(weights, found, strict=True)) / sum(weights)
    chosen = [f for f in found if smooth[f[0]] >= bound]
    total = sum(len(f[4]) for f in chosen)
    holders = {e: k for f in chosen for k, e in enumerate(f[1], 1) if sum(len(g[4]) for g in chosen if e in g[1]) >= h.HELD * total}
    holder = max(holders, key=holders.get) if holders else None
    if holder is not None and len(chosen) > 1 and any(f[1][-1] == holder for f in chosen):
        chain = next(f[1] for f in chosen if f[1][-1] == holder)
        holder = chain[-2] if len(chain) > 1 else None
    stays = [f for f in chosen if f[3] or holder is None or holder in f[1] or factor(f[0]) * fused(len(f[4]), marks(f[4])) >= bound]
    if all(factor(f[0]) < 1 for f in stays) and sum(len(f[4]) for f in stays) < h.LEAST_MARKED:
        return ""
    return " ".join(f[4] for f in stays)


def test_random_pages_equal_the_naive_form():
    draw, some = random.Random(11), 0
    for _ in range(400):
        page = tree(draw)
        got = h.main_text("<html>" + render(page) + "</html>")
        assert got == naive_text(("html", "", [page]))
        some += bool(got)
    assert some > 300


STORY = "It was a long day, and the story went on; nobody, as they say, was in a hurry to leave the house. "


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<p>E is <math><mi>m</mi><mo>c</mo></math> here, as they say.", "E is mc here, as they say."),
        (f"<article><p>{STORY}</p><p><a href=x>One link alone</a></p></article>", STORY + "One link alone"),
        (f"<div><p>{STORY}<span class='advert'>Buy <b>now</b></span> and on.</p></div>", STORY + "and on."),
        (f"<div><p>{STORY}<em hidden>secret</em>and on.</p></div>", STORY + "and on."),
        (f"<div class='story'><h2>Head</h2><p>{STORY}</p></div><div class='teaser'><p>Short</p></div>", "Head " + STORY.strip()),
        (f"<article><p>{STORY}</p><table><tr><td>12</td><td>13</td></tr></table></article>", STORY + "12 13"),
        ("<article><h1>On</h1><p>Be.</p></article><footer>&copy; A long footer, with words; and more of them.</footer>", "On Be."),
        ("<article><h1></h1></article><div class='ad'>Buy this, now; it is cheap.</div>", ""),
        (f"<div><p>{STORY}</div><script>if (a < b) {{ x = '</p>'; }}</script><p title=\"a > b\">{STORY}", STORY + STORY.strip()),
        ("1 < 2 &amp; 3 > 2, they say.", "1 < 2 & 3 > 2, they say."),
    ],
)
def test_pages_of_many_forms(body, want):
    assert h.main_text(f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{body}") == want.strip()


def test_ratios_decide_and_not_the_marks_alone(monkeypatch):
    page = f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy this.</div><article><h1>A</h1><p>{STORY}</p></article><footer>us</footer>"
    assert h.main_text(page) == "A " + STORY.strip()
    monkeypatch.setattr(h, "path_ratios", lambda found: {b.path.number: 1.0 for b in found})
    assert h.main_text(page).startswith("Home A ")  # an advert's own block still counts a tenth


@pytest.mark.parametrize("part", ["<a ", '<a "', '<b x="> " ', "<div>x", "</x>", "<div></p>", "<script>", "</script ", "<!--", "<", "<a<", "&", '<p class="'])
def test_broken_pages_take_linear_time(part):
    began = time.process_time()
    for page in (part * 50_000, "<p>hello. " + part * 50_000 + ">"):
        h.main_text(page)
    assert time.process_time() - began < 30
