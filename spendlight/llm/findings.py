"""Labelled findings: texts with a secret or a look-alike at a known place.

They are written apart from the detector and its features, by what secrets and their look-alikes are in
files (keys, passwords, connection strings against digests, identifiers, placeholders and paths), so that the forest
learns from labels that no rule over its own inputs has given. The same seed gives the same findings.
"""

from __future__ import annotations

import base64
import random

# fixed values: names and forms that files use
CREDENTIAL_NAMES = "api_key apiKey API_KEY auth_token access_token client_secret db_password DB_PASS passwd password pwd secret secretKey private_key token session_token x-api-key".split()
DIGEST_NAMES = "sha sha1 sha256 md5 checksum digest etag commit revision build_id uuid request_id trace_id fingerprint version object_id".split()
PLAIN_NAMES = "title user path url file module label branch region endpoint description hostname class template locale theme".split()
PLACEHOLDERS = "changeme change-me-please your-api-key-here your_password_here <your-token-here> ${DB_PASSWORD} {{api_token}} xxxxxxxxxxxxxxxx ****************".split()
PLACEHOLDERS += "example-secret-key test_password_value dummy-token-123 not-a-real-secret placeholder_value my_secret_password sample_api_key_0000 insert-token-here password1234 default_password none_required REDACTED_BY_ADMIN".split()
WORDS = "application block buffer cache channel cluster column config connection context count default device directory document element engine entry error event example field filter folder format frame group handler header index input instance iterator layer level library listener manager map message method model module name network node number object option output package page parameter parser path pattern pool process profile project property query queue record region report request resource response result route row runtime sample schema scope script section server service session signal size source stage state status stream string system table target task template test thread time token tree type update user util value vector version view window worker".split()
HEX, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _identifier(rng: random.Random) -> str:
    words = [rng.choice(WORDS) for _ in range(rng.randrange(3, 6))]
    style = rng.randrange(4)
    if style == 0:
        return "_".join(words) + f"_v{rng.randrange(1, 30)}"
    if style == 1:
        return words[0] + "".join(w.title() for w in words[1:]) + str(rng.randrange(10, 9999))
    if style == 2:
        return "/" + "/".join(words) + f"/{rng.choice(WORDS)}{rng.randrange(9)}.py"
    return "-".join(words) + f"-{rng.randrange(2018, 2027)}-{rng.randrange(1, 13):02d}"


def _uuid(rng: random.Random) -> str:
    return "-".join("".join(rng.choices(HEX, k=k)) for k in (8, 4, 4, 4, 12))


def _secret(rng: random.Random) -> str:
    pick = lambda letters, low, high: "".join(rng.choices(letters, k=rng.randrange(low, high)))
    form = rng.randrange(6)
    if form == 0:
        return pick(HEX, 18, 64)
    if form == 1:
        return pick(ALNUM + "_-", 20, 60)
    if form == 2:
        return base64.b64encode(rng.randbytes(rng.randrange(18, 48))).decode().rstrip("=")
    if form == 3:
        # passwords as people make them
        word = rng.choice(WORDS)
        return f"{word.title() if rng.random() < 0.5 else word}{rng.choice('!@#$%&*_')}{rng.randrange(10, 99999)}{pick(ALNUM, 1, 6)}"
    return pick(ALNUM + "!@#%^&*", 10, 24)


def _look_alike(rng: random.Random, name: str) -> str:
    if name in CREDENTIAL_NAMES:
        return rng.choice(PLACEHOLDERS) if rng.random() < 0.7 else "_".join(rng.choice(WORDS) for _ in range(3))
    if name in DIGEST_NAMES:
        return _uuid(rng) if rng.random() < 0.3 else "".join(rng.choices(HEX, k=rng.choice((32, 40, 64))))
    return _identifier(rng)


def labelled(count: int, seed: int = 11) -> list[tuple[str, str, int, int]]:
    """``(text, source, start, label)`` of ``count`` findings, secrets and look-alikes in turn."""
    rng, out = random.Random(seed), []
    near = {1: ["login", "auth", "credential", "bearer", "key", "secret"], 0: ["commit", "checksum", "docs", "example", "sample", "digest"]}
    for i in range(count):
        label = i % 2
        words = lambda: " ".join("".join(rng.choices("aeinorst", k=rng.randrange(2, 9))) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(rng.randrange(1, 7)))
        before = words() + (f" {rng.choice(near[label])} " if rng.random() < 0.3 else " ")
        if label:
            name, value = rng.choice(CREDENTIAL_NAMES), _secret(rng)
            forms = [f'{name} = "{{}}"', f"{name}={{}} ", f'"{name}": "{{}}"', f"{name}: '{{}}'", "Authorization: Bearer {} ", f"postgres://{rng.choice(WORDS)}:{{}}@db.host/x"]
            form = rng.choice(forms[:5] if set(value) & set("@/&#%^") else forms)
        else:
            name = rng.choice(CREDENTIAL_NAMES if rng.random() < 0.35 else DIGEST_NAMES if rng.random() < 0.5 else PLAIN_NAMES)
            value = _look_alike(rng, name)
            form = rng.choice([f'{name} = "{{}}"', f"{name}={{}} ", f'"{name}": "{{}}"', f"{name} {{}} "])
        head, tail = form.split("{}")
        source = rng.choice(["src/app", "deploy/prod", "etc/service"] if label or rng.random() < 0.6 else ["docs/guide", "tests/data", "examples/basic"])
        out.append((f"{before}{head}{value}{tail} {words()}", source, len(before) + len(head), label))
    return out
