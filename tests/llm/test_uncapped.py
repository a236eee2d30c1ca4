"""Nothing is cut: long runs are decoded exactly, and keys of any size are parsed to their end."""

import base64
import random
import textwrap

import numpy as np

from regionspark.llm import secrets, toxicity


def letters_model(seed):
    rng = np.random.default_rng(seed)
    return toxicity.language_model(rng.integers(0, 50, (toxicity.LETTERS,) * 3))


def test_long_runs_are_decoded_exactly(monkeypatch):
    """Letting go of what all paths share changes nothing, wherever it is done."""
    rng = random.Random(2)
    for k in range(6):
        decoder = toxicity.Decoder(letters_model(k))
        word = "".join(rng.choice("abc0134!$@|+ .-ee") for _ in range(5_000 if k < 2 else 1_399))
        for apart in (False, True):
            texts = []
            for shared in (1 << 60, 1024, 37):
                monkeypatch.setattr(toxicity, "SHARED", shared)
                texts.append(decoder._viterbi(word, apart))
            assert texts[0] == texts[1] == texts[2] and texts[0]


def test_decoding_against_all_readings():
    """The likeliest path among all that the lattice has, by enumeration."""
    log_p = letters_model(9)
    cost, rng = toxicity.STEP_COSTS, random.Random(4)

    def best(word, at, a, b, score, text):
        if at == len(word):
            end = log_p[a][b][toxicity.END] if b != toxicity.END else 0.0
            return [(score + end, text)]
        c, out = word[at], []
        readings = [(r, cost["leet"]) for r in toxicity.LEET.get(c, "")] + ([(c, cost["letter"])] if c.isalpha() else [])
        for r, k in readings:
            out += best(word, at + 1, b, toxicity._code(r), score + log_p[a][b][toxicity._code(r)] - k, text + r)
        if at and word[at - 1] == c:
            out += best(word, at + 1, a, b, score - cost["dropped repeat"], text)
        if c in toxicity.SEPARATORS:
            out += best(word, at + 1, a, b, score - cost["dropped separator"], text)
            if b != toxicity.END:
                out += best(word, at + 1, toxicity.END, toxicity.END, score + log_p[a][b][toxicity.END] - cost["dropped separator"], text + " ")
        elif not c.isalpha():
            out += best(word, at + 1, a, b, score - cost["kept mark"], text)
        return out

    decoder = toxicity.Decoder(log_p)
    for _ in range(60):
        word = "".join(rng.choice("ab1|0$. -ee") for _ in range(rng.randrange(1, 9)))
        found = decoder._viterbi(word, True)
        paths = best(word, 0, toxicity.END, toxicity.END, 0.0, "")
        assert any(text == found and abs(score - max(paths)[0]) < 1e-9 for score, text in paths)


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + content


def integer(n_bytes, seed):
    return der(2, bytes([0x41]) + random.Random(seed).randbytes(n_bytes - 1))


def rsa_key(n_bytes):
    return der(0x30, der(2, b"\0") + b"".join(integer(n_bytes // 8, k) for k in range(8)))


def ssh_field(x):
    return len(x).to_bytes(4, "big") + x


def kinds(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.scan(text) if k > 2]


def test_keys_beyond_any_size():
    key = rsa_key(120_000)
    plain = base64.b64encode(key).decode()
    wrapped = "\n".join(textwrap.wrap(plain, 64))
    upper = key.hex().upper()
    colons = ":".join(textwrap.wrap(upper, 2))
    for body in (plain, wrapped, upper, colons, "\n".join(textwrap.wrap(upper, 80))):
        assert kinds(f"key: {body} end") == [("der", body)], body[:40]
    cut = plain[:-400]
    assert kinds(f"key: {cut} end") == []
    many = ssh_field(b"ssh-ed25519") + ssh_field(bytes(range(32)))
    private = secrets._SSH_MAGIC + ssh_field(b"none") + ssh_field(b"none") + ssh_field(b"") + (90).to_bytes(4, "big") + ssh_field(many) * 90 + ssh_field(b"x" * 70_000)
    body = base64.b64encode(private).decode()
    assert kinds(f"key: {body} end") == [("ssh", body)]


def test_long_header_fields():
    body = base64.b64encode(random.Random(1).randbytes(160)).decode()
    note = "Comment: " + "c" * 5_000
    text = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n{note}\nDEK-Info: AES-128-CBC,{'0F' * 16}\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert kinds("a " + text + " b") == [("pem", text)]
