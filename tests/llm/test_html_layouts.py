"""Main texts of hand-written layouts, which no generator made: articles in unnamed elements, in the body itself, in table cells and forms."""

import random

import pytest
from peakgrid.llm import html_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
R = random.Random(1)
TEXTS = [" ".join(R.choice(WORDS) for _ in range(25)).capitalize() + "." for _ in range(6)]
A = "<h1>A title of words</h1>" + "".join(f"<p>{t}</p>" for t in TEXTS)
WANT = "\n".join(["A title of words", *TEXTS])
NAV = "<nav><a href=/>Home</a> <a href=/a>About us</a> <a href=/c>Contact</a></nav>"
FOOT = "<footer><p>Copyright 2020 Some Company</p></footer>"
DIVS = "".join(f"<div>{t}</div>" for t in TEXTS)
LAYOUTS = {
    "div": f'<body>{NAV}<div>{A}</div></body>',
    "body": f'<body>{NAV}{A}{FOOT}</body>',
    "body alone": f'<body>{A}</body>',
    "body nav": f'<body>{NAV}{A}</body>',
    "td": f'<body>{NAV}<table><tr><td>{A}</td></tr></table></body>',
    "form": f'<body><form id=aspnetForm>{NAV}<div class=content>{A}</div></form></body>',
    "no body": f'{A}',
    "div foot": f'{NAV}<div>{A}</div>{FOOT}',
    "td side": f'<table><tr><td><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></td><td>{A}</td></tr></table>',
    "wrapper": f'<body><div id=wrapper><div id=header>Site name</div><div id=menu><ul><li><a href=/>Home</a></li><li><a href=/b>B</a></li></ul></div><div>{A}</div><div id=footer>Imprint</div></div></body>',
    "main": f'{NAV}<main>{A}</main>{FOOT}',
    "article": f'{NAV}<article>{A}</article>{FOOT}',
    "entry": f'{NAV}<div class=entry>{A}</div>{FOOT}',
    "section": f'{NAV}<section>{A}</section>{FOOT}',
    "form div": f'<form id=form1><div>{A}</div></form>',
    "bootstrap": f'{NAV}<div class=container><div class=row><div class="col-md-8">{A}</div><div class="col-md-4 sidebar"><h3>Popular</h3><ul><li><a href=/x>One thing</a></li><li><a href=/y>Another thing</a></li></ul></div></div></div>{FOOT}',
    "sections": f'{NAV}<section><h1>A title of words</h1><p>{TEXTS[0]}</p><p>{TEXTS[1]}</p></section><section><p>{TEXTS[2]}</p><p>{TEXTS[3]}</p></section><section><p>{TEXTS[4]}</p><p>{TEXTS[5]}</p></section>{FOOT}',
    "td cont": f'{NAV}<table><tr><td class=content>{A}</td></tr></table>',
    "comments": f'{NAV}<div>{A}</div><div class=comments><h3>Comments</h3><div class=comment><p>Nice words here.</p></div></div>{FOOT}',
    "divs": f'{NAV}<div><h1>A title of words</h1>{DIVS}</div>{FOOT}',
    "custom": f'<div class="x-top">{NAV}</div><div class="zq"><div class="kk">{A}</div></div><div class="x-foot"><p>Copyright 2020</p></div>',
    "cookie": f'<div class=cookie-banner><p>We use cookies on this site.</p><button>OK</button></div>{NAV}<div>{A}</div>{FOOT}',
}
ONE = " ".join(TEXTS)
BARE = {"a body of text": f"<body>{ONE}</body>", "text between menu and footer": f"<body>{NAV}{ONE}{FOOT}</body>", "no markup": ONE}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_article_is_found_whole(name):
    page = f"<!DOCTYPE html><html><head><title>T</title></head>{LAYOUTS[name]}</html>"
    assert html_text.main_texts([page], html_text.fit()) == [WANT]


@pytest.mark.parametrize("name", list(BARE))
def test_bare_text_is_found(name):
    assert html_text.main_texts([BARE[name]], html_text.fit()) == [ONE]
