"""The labelled table that the tagger of personal data is trained on by default: invented lines with marked spans.

Lines come from templates and values from a seeded generator, so no line or
value is taken from any corpus. A mark is ``<kind>...</kind>``. Lines without a
mark show numbers and words that are no personal data.
"""

from __future__ import annotations

import random
import string

_NAMES = "alba bruno celia dario edna felix greta hugo irma jonas kira lars mona nils olga pavel quinn rosa sven tilda ugo vera willem xenia yuri zora".split()
_HOSTS = "harbor meadow lantern quarry willow copper saffron juniper granite velvet".split()
_WORDS = "amber bottle cradle dragon ember falcon garnet hollow island jigsaw kettle ladder marble nectar orchid pepper quiver ribbon saddle timber umbrella violet walnut yonder zephyr".split()
_PLACES = "the office, the depot, the clinic, our branch, the front desk, the night shift".split(", ")


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _email(r: random.Random) -> str:
    own = r.choice(_NAMES) + r.choice(["", ".", "_", "-", "+"]) + r.choice([*_NAMES, _digits(r, 2), _digits(r, 3)])
    return f"{own}@{r.choice(['', 'mail.', 'post.', 'mx' + _digits(r, 1) + '.'])}{r.choice(_HOSTS)}{r.choice(['', _digits(r, 1)])}.{r.choice(['example', 'test', 'invalid', 'org', 'net'])}"


def _ip(r: random.Random) -> str:
    return ".".join(str(r.randint(0 if i else 1, 255)) for i in range(4))


def _card(r: random.Random) -> str:
    n = r.choice([15, 16, 16, 16])
    body = r.choice("3456") + _digits(r, n - 2)
    total = 0
    for i, c in enumerate(reversed(body)):
        x = int(c) * (2 - i % 2)
        total += x - 9 if x > 9 else x
    body += str(-total % 10)
    gap = r.choice(["", "", " ", "-"])
    return gap.join(body[i : i + 4] for i in range(0, len(body), 4))


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([
        f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{r.randint(1, 99)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{r.randint(30, 99)} {d(3)} {d(4)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}",
        f"0{d(2)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(4)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
    ])


def _hex(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def _secret(r: random.Random) -> str:
    return r.choice([
        _hex(r, r.choice([16, 18, 20, 24, 32, 40])), _hex(r, 40), _hex(r, r.choice([32, 40])).upper(), "".join(r.sample(_WORDS, 1)) + _digits(r, 4), "".join(r.sample(_WORDS, 3)),
        "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(12, 28))), r.choice(_WORDS).title() + r.choice(_WORDS).title() + _digits(r, 2), "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(10, 18))),
    ])


def _key(r: random.Random) -> str:
    """A capital access key: a fixed prefix and sixteen capitals and digits."""
    return "AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16))


#: Templates: {kind} stands for a marked value, {n1} to {n6} for plain numbers, {w} for a word, {place} for a place.
TRAINING = """
Call {phone} today or write to {email} soon.
Her number is {phone}, ask at {place}.
Tel. {phone} or fax {phone}
phone: {phone}
mobile {phone} works at night
please ring {phone} before noon
You reach {place} under {phone} on weekdays
contact {email}
The mail {email} is read daily by {place}
mails to {email} of the {w}
reply to {email} or {email}
Server {ip} is down since noon.
host {ip} answered
the logs came from {ip} and {ip}
ping {ip} again
card {card} was charged
paid with {card} on Monday
the card {card} is lost, call {phone}
{card} {card} are both on file
the {w} gave {card} to {place}
password={secret} was set
password = "{secret}" in the file
passwd: {secret} is old
the password is {secret} for {place}
pwd {secret}
passphrase: {secret}
token = "{secret}" expired
token="{secret}"
TOKEN: {secret}
api_key: {secret} and more
secret={secret}
access_key = '{secret}' rotated
login secret {secret} leaked
bearer token {secret}
the key {key} leaked
use {key} here
key {key} of the account
{key} was seen in {place}
and {key} stands in the {w}
his password was {secret} until {n4}
Licensed under CC BY-NC {n1}.{n1}.
the General Public License, version {n1}.
In {n4} there were {n2},{n3} people in {n1} towns.
It cost {n2}.{n2} and later {n1},{n3}.{n2} at {n2}:{n2}
Chapter {n2} begins on page {n3} of {n3}
On {n4}-{n2}-{n2} at {n2}:{n2} he left for {n1} days.
The years {n4} {n4} and {n4} {n4} were bad.
Room {n3}, floor {n1}, building B{n1}
version {n1}.{n1}.{n1} came after {n1}.{n1}.{n1} and before {n1}.{n1}
Section {n1}.{n1}.{n1} says so; see table {n1}.
order {n2} and {n2} of {n3}
the numbers {n1} {n1} {n1} {n1} {n1} {n1} {n1}
MP{n1} files and the A{n1} paper of H{n1}O
the B{n2} and the {n3} flew at {n3} km/h
score {n1}-{n1} after {n2} minutes, {n5} watched
commit {n1}f{n1}a{n1}c{n1} fixed it
on {n2}/{n2}/{n4} in {n1}st class, {n1}nd row
about {n2}% of {n6} people
model T{n4} and part AB{n4}
{n2}.{n1} kg or {n2}.{n1} pounds, {n1}.{n5}
@user said hi to @other at {n1}pm
the {n4}s and the {n2}st century
ratio {n2}:{n1} at {n4}p and {n2} Hz
postcode {n5} or {n5} in town
value x{n1} = {n1} and y{n1} = {n2}
the key {w} of the {w} is here
the password of the {w} was lost
a secret {w} in the {w}
no token {w} was given to {place}
his secret garden and the key words
the password must be changed every {n2} days
pass the {w} to {place}
the key point is the {w}
keys and tokens for the {w}
a number like {n6}{n5}{n5} was found
id {n6}{n6} of the {w}
call the {w} at {n1} o'clock
phone the {w} before {n2}:{n2}
tel. numbers are listed on page {n3}
""".strip().split("\n")

#: Other templates, for measuring on lines that training has not seen.
HELD_OUT = """
und das token = "{secret}" im Text
schreib an {email} oder ruf {phone} an
from {ip} at {n2}:{n2}
In {n4} some {n1},{n3} people read {n2} books on page {n2}.
Chapter {n1} of version {n1}.{n1} costs {n2}.{n2} in {n4}
her card {card} and the address {email}
a login from {ip} with password={secret} today
la clef {key} est ici
write {email} now
mobile: {phone}; fax: {phone}
number {card} belongs to {place}
the api_key = "{secret}" was found by {place}
passwd={secret}
room {n3} on floor {n2} has {n2} seats
the secret of the {w} is the {w}
a key to the {w}
between {n4} and {n4} about {n3} {w}s were sold
{n2} of {n3} tokens were lost
call {phone} or {phone}
the password is {secret}
""".strip().split("\n")


def lines(templates: list[str] = TRAINING, copies: int = 4, seed: int = 20) -> list[str]:
    """Marked lines: each template filled with so many sets of values."""
    r = random.Random(seed)
    make = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "secret": _secret, "key": _key}
    out = []
    for t in templates:
        for _ in range(copies):
            line = t
            for kind, f in make.items():
                while "{" + kind + "}" in line:
                    name = "secret" if kind == "key" else kind
                    line = line.replace("{" + kind + "}", f"<{name}>{f(r)}</{name}>", 1)
            for n in range(1, 7):
                while "{n%d}" % n in line:
                    line = line.replace("{n%d}" % n, str(r.randint(1, 9)) + _digits(r, n - 1), 1)
            while "{w}" in line:
                line = line.replace("{w}", r.choice(_WORDS), 1)
            out.append(line.replace("{place}", r.choice(_PLACES)))
    return out
