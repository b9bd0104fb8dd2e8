"""Training of the block labeller on generated layouts: python -m textrine.llm.html_train

Pages are invented: article bodies of many shapes among menus, headers,
footers, sidebars, notices, adverts, forms and reader comments, under many
element, class and id names, in random order and with broken markup. Every
text is tagged with a mark that tells its label, so that labels follow the
text through the same block cutter that extraction uses.
"""

from __future__ import annotations

import random

import numpy as np

from textrine.llm.html_extract import HIDDEN, INPUT, WEIGHTS, Labeller, Vectors, blocks, sigmoid

MARK = ""  # ends each article text in generated pages; private use, never in real words

SYLLABLES = "an er th in on re st en ti ed or le de la que ción ra te ung ver sch ein ou eau men al is to and of el".split()
CLASSES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links tabs pagination pager toc skip".split(),
    "header": "header masthead banner top logo branding site-title tagline hero-bar topbar".split(),
    "footer": "footer foot bottom copyright legal colophon site-info site-footer imprint".split(),
    "aside": "sidebar aside side widget related recommended popular trending more-stories promo author-box newsletter tags share social".split(),
    "notice": "cookie notice alert consent gdpr modal popup overlay warning paywall subscribe-notice toast info-bar".split(),
    "ad": "ad ads advert advertisement sponsored promo-box banner-ad sponsor adslot commercial outbrain taboola".split(),
    "form": "form search login signup subscribe newsletter-form contact poll searchbox register".split(),
    "comments": "comments comment comment-list replies discussion responses disqus reader-comments reactions feedback".split(),
}
CONTENT = "content article post entry body main text story post-content article-body entry-content main-content post-body article-text page-content richtext".split()
PHRASES = {
    "nav": "home about contact products news sports archive login next previous".split(),
    "header": "welcome menu search our site the daily".split(),
    "footer": "copyright all rights reserved privacy terms imprint contact".split(),
    "aside": "related popular share follow read more tags latest author subscribe".split(),
    "notice": "we use cookies accept settings privacy consent this site".split(),
    "ad": "sponsored advertisement buy now offer sale free click".split(),
    "form": "name email password submit send search subscribe your message".split(),
    "comments": "reply says posted ago great thanks agree comment likes anonymous".split(),
}


def word(r: random.Random) -> str:
    return "".join(r.choices(SYLLABLES, k=r.choice((1, 1, 2, 2, 3, 4))))


def sentence(r: random.Random, n: int) -> str:
    noise = r.random() < 0.08
    words = [word(r) + (r.choice(("###", "%%%", "***", "&amp;&amp;", "$$$", "!!", " |")) if noise else "," * (r.random() < 0.08)) for _ in range(n)]
    return (" ".join(words)).capitalize() + r.choice((".", ".", ".", "", "!", "?"))


def prose(r: random.Random, longest: int = 4) -> str:
    x = r.random()
    if x < 0.05:  # the same word or few words again and again
        some = [word(r) for _ in range(r.randint(1, 4))]
        return " ".join(w.capitalize() if r.random() < 0.5 else w for w in some for _ in range(r.randint(1, 60)))
    if x < 0.12:  # words that are usual in boilerplate, in any text
        return " ".join(r.choice(r.choice(list(PHRASES.values()))) if r.random() < 0.5 else word(r) for _ in range(r.randint(1, 14))) + r.choice((".", "", "!"))
    if x < 0.16:  # numbers, keys and signs
        return " ".join(r.choice((word(r), str(r.randrange(10**12)), f"{r.randrange(256)}.{r.randrange(256)}.1.2", "|", "###", "%%%", f"{word(r)}@{word(r)}.com", "license version 3 gnu")) for _ in range(r.randint(1, 25)))
    if x < 0.2:
        return " ".join(word(r).upper() + "!!" for _ in range(r.randint(1, 40)))
    return " ".join(sentence(r, r.choice((1, 2, 4, 8, 12, 18, 30))) for _ in range(r.randint(1, longest)))


def attributes(r: random.Random, names: list[str]) -> str:
    if r.random() < 0.25:
        return ""
    chosen = r.choice(names)
    kind = r.random()
    if kind < 0.6:
        return f' class="{chosen}"' if r.random() < 0.6 else f' class="{chosen} {word(r)}"'
    return f' id="{chosen}"' if kind < 0.85 else f" id='{word(r)}' class='{chosen}-{r.choice(('box', 'wrap', 'area', '1', 'inner'))}'"


def wrap(r: random.Random, tag: str, names: list[str], inner: str) -> str:
    if tag == "div" or r.random() < 0.3:
        given = attributes(r, names)
        while tag == "div" and not given:
            given = attributes(r, names)
    else:
        given = ""
    return f"<{tag}{given}>{inner}</{tag}>"


def link(r: random.Random, text: str) -> str:
    return f'<a href="/{word(r)}">{text}</a>'


def chrome(r: random.Random, kind: str) -> str:
    """Some boilerplate of one kind."""
    phrase = lambda: " ".join(r.choices(PHRASES[kind], k=r.randint(1, 4))) if r.random() < 0.45 else " ".join(word(r) for _ in range(r.randint(1, 5)))
    names = CLASSES[kind]
    items = lambda n, f: "".join(f"<li>{f()}</li>" for _ in range(n))
    if kind == "nav":
        inner = f"<ul>{items(r.randint(2, 12), lambda: link(r, phrase()))}</ul>" if r.random() < 0.8 else " ".join(link(r, phrase()) for _ in range(r.randint(2, 9)))
        return wrap(r, r.choice(("nav", "nav", "div", "ul")), names, inner)
    if kind == "header":
        return wrap(r, r.choice(("header", "header", "div")), names, r.choice((f"<h1>{phrase()}</h1><p>{phrase()}</p>", link(r, phrase()), f"<span>{phrase()}</span>")) + (chrome(r, "nav") if r.random() < 0.4 else ""))
    if kind == "footer":
        inner = r.choice((f"&copy; {phrase()} &middot; {prose(r, 2)}", f"<p>{prose(r, 2)}</p>", f"<ul>{items(4, lambda: link(r, phrase()))}</ul><p>&copy; {phrase()}</p>", prose(r, 2)))
        return wrap(r, r.choice(("footer", "footer", "div")), names, inner)
    if kind == "aside":
        inner = r.choice((f"<h3>{phrase()}</h3><ul>{items(r.randint(2, 6), lambda: link(r, sentence(r, 6)))}</ul>", f"<p>{prose(r, 3)}</p>", f"<h2>{phrase()}</h2><p>{prose(r, 2)}</p>{link(r, phrase())}"))
        return wrap(r, r.choice(("aside", "aside", "div", "section")), names, inner)
    if kind == "form":
        inner = f"<label>{phrase()}</label><input name=q><button>{phrase()}</button>" + (f"<p>{prose(r, 1)}</p>" if r.random() < 0.4 else "")
        return wrap(r, r.choice(("form", "form", "div")), names, inner if r.random() < 0.7 else f"<form>{inner}</form>")
    if kind == "comments":
        one = lambda: wrap(r, r.choice(("div", "li", "article")), names, f"<b>{word(r)}</b> <p>{prose(r, 3)}</p>" if r.random() < 0.6 else f"<p>{phrase()}</p><p>{prose(r, 3)}</p>")
        return wrap(r, r.choice(("section", "div", "ol")), names, (f"<h3>{phrase()}</h3>" if r.random() < 0.7 else "") + "".join(one() for _ in range(r.randint(1, 7))))
    inner = r.choice((phrase(), prose(r, 2), f"<p>{prose(r, 2)}</p>", f"{phrase()} {link(r, phrase())}"))
    return wrap(r, r.choice(("div", "div", "section", "aside" if kind == "ad" else "div")), names, inner)


def article(r: random.Random) -> str:
    out = []
    if r.random() < 0.8:
        out.append(f"<h1>{sentence(r, r.randint(1, 12))}{MARK}</h1>")
    style = r.random()
    for _ in range(r.choice((1, 2, 3, 5, 8, 13, 25, 40))):
        x = r.random()
        if style < 0.35 and x < 0.15:
            out.append(f"<p><b>{prose(r)}{MARK}<br>")
        elif x < 0.8:
            out.append(f"<p>{prose(r)}{MARK}</p>")
        elif x < 0.86:
            out.append(f"<h{(k := r.choice('2234'))}>{sentence(r, r.randint(1, 7))}{MARK}</h{k}>")
        elif x < 0.92:
            t = r.choice(("ul", "ol"))
            out.append(f"<{t}>" + "".join(f"<li>{sentence(r, r.randint(2, 14))}{MARK}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
        elif x < 0.95:
            out.append(f"<blockquote>{prose(r)}{MARK}</blockquote>")
        elif x < 0.97:
            out.append(f"<p>{sentence(r, 5)} {link(r, word(r))} {prose(r, 2)}{MARK}</p>")
        elif r.random() < 0.5:
            out.append(chrome(r, r.choice(("ad", "aside", "notice", "form"))))
        else:
            out.append(f"<table><tr><td>{sentence(r, 3)}{MARK}</td><td>{sentence(r, 4)}{MARK}</td></tr></table>")
    body = "".join(out)
    x = r.random()
    if x < 0.45:
        body = f"<article{attributes(r, CONTENT) if r.random() < 0.4 else ''}>{body}</article>"
    elif x < 0.6:
        body = f"<main>{body}</main>"
    else:
        body = f"<div{attributes(r, CONTENT)}>{body}</div>"
    return f"<main>{body}</main>" if r.random() < 0.15 else f"<div{attributes(r, ['wrapper', 'container', 'page', 'row', 'col'])}>{body}</div>" if r.random() < 0.3 else body


def page(r: random.Random) -> str:
    before = [k for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.4]
    after = [k for k in ("aside", "ad", "comments", "form", "notice", "nav", "footer") if r.random() < 0.42]
    r.shuffle(before)
    body = "".join(chrome(r, k) for k in before) + (article(r) if r.random() < 0.97 else "") + "".join(chrome(r, k) for k in after)
    if r.random() < 0.2:
        body = f"<div{attributes(r, ['wrapper', 'container', 'page', 'site'])}>{body}</div>"
    return f"<html><head><title>{sentence(r, 5)}</title><script>var a='<p>x</p>';</script></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def examples(n: int, seed: int):
    r, vectors = random.Random(seed), Vectors()
    out = []
    for _ in range(n):
        found = [(p, t.replace(MARK, "").strip() or "x", k, MARK in t) for p, t, k in blocks(page(r))]
        if found:
            out.append((vectors.page([f[:3] for f in found]), np.array([f[3] for f in found], np.float32)))
    return out


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w[f"w{d}"] = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN))
        w[f"u{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"b{d}"] = np.zeros(4 * HIDDEN)
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    w["v"], w["c"] = rng.normal(0, 0.2, (2 * HIDDEN, 1)), np.zeros(1)
    return w


def forward(x, mask, w, u, b):
    steps, pages, _ = x.shape
    h = np.zeros((steps + 1, pages, HIDDEN))
    c = np.zeros((steps + 1, pages, HIDDEN))
    gates = np.zeros((steps, pages, 4 * HIDDEN))
    inputs = x @ w + b
    for t in range(steps):
        z = inputs[t] + h[t] @ u
        g = gates[t]
        g[:, : 3 * HIDDEN], g[:, 3 * HIDDEN :] = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o, a = np.split(g, 4, axis=1)
        m = mask[t][:, None]
        c[t + 1] = m * (f * c[t] + i * a) + (1 - m) * c[t]
        h[t + 1] = m * (o * np.tanh(c[t + 1])) + (1 - m) * h[t]
    return h, c, gates


def backward(x, mask, w, u, state, dh_out):
    h, c, gates = state
    steps, pages, _ = x.shape
    dz_all = np.zeros((steps, pages, 4 * HIDDEN))
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    for t in range(steps - 1, -1, -1):
        m = mask[t][:, None]
        i, f, o, a = np.split(gates[t], 4, axis=1)
        dh_t = dh + dh_out[t]
        th = np.tanh(c[t + 1])
        dhm = dh_t * m
        dcm = dc * m + dhm * o * (1 - th**2)
        dz_all[t] = np.concatenate([dcm * a * i * (1 - i), dcm * c[t] * f * (1 - f), dhm * th * o * (1 - o), dcm * i * (1 - a**2)], axis=1)
        dh = dz_all[t] @ u.T + dh_t * (1 - m)
        dc = dcm * f + dc * (1 - m)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, INPUT).T @ flat, h[:-1].reshape(-1, HIDDEN).T @ flat, flat.sum(0)


def train(pages: int = 12_000, epochs: int = 8, seed: int = 3) -> dict[str, np.ndarray]:
    data = examples(pages, seed)
    w = initial(seed)
    m, s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        # pages of like length together, in random order of batches
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) // 8)
        cuts = [order[i : i + 32] for i in range(0, len(order), 32)]
        random.Random(epoch).shuffle(cuts)
        total = wrong = 0
        for some in cuts:
            steps = max(len(data[i][0]) for i in some)
            x, y, mask = np.zeros((steps, len(some), INPUT)), np.zeros((steps, len(some))), np.zeros((steps, len(some)))
            back = np.zeros_like(x)
            for k, i in enumerate(some):
                n = len(data[i][0])
                x[:n, k], back[:n, k], y[:n, k], mask[:n, k] = data[i][0], data[i][0][::-1], data[i][1], 1
            turn = lambda a, some=some: np.stack([np.concatenate([a[: len(data[i][0]), k][::-1], a[len(data[i][0]) :, k]]) for k, i in enumerate(some)], axis=1)
            sf, sb = forward(x, mask, w["wf"], w["uf"], w["bf"]), forward(back, mask, w["wb"], w["ub"], w["bb"])
            h = np.concatenate([sf[0][1:], turn(sb[0][1:])], axis=2)
            p = sigmoid(h @ w["v"] + w["c"])[:, :, 0]
            d = (p - y) * mask / mask.sum()
            total, wrong = total + mask.sum(), wrong + (((p > 0.5) != (y > 0.5)) * mask).sum()
            dh = d[:, :, None] * w["v"][:, 0]
            grad = {"v": h.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "c": np.array([d.sum()])}
            grad["wf"], grad["uf"], grad["bf"] = backward(x, mask, w["wf"], w["uf"], sf, dh[:, :, :HIDDEN])
            grad["wb"], grad["ub"], grad["bb"] = backward(back, mask, w["wb"], w["ub"], sb, turn(dh[:, :, HIDDEN:]))
            step += 1
            rate = 0.01 * (0.5 if epoch >= epochs - 3 else 1) * (0.3 if epoch == epochs - 1 else 1)
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: {wrong / total:.4f} of the blocks wrong", flush=True)
    return w


def accuracy(model: Labeller, pages: int = 500, seed: int = 99) -> float:
    data = examples(pages, seed)
    got = model.label([x for x, _ in data])
    return float(np.mean(np.concatenate([(p > 0.5) == (y > 0.5) for p, (_, y) in zip(got, data)])))


def main() -> None:
    w = train()
    np.savez_compressed(WEIGHTS, **{k: x.astype(np.float32) for k, x in w.items()})
    print(f"held-out pages: {accuracy(Labeller.load()):.4f} of the blocks right")


if __name__ == "__main__":
    main()
