import base64
import binascii
import hashlib
import json
import random

from loomgraph.llm import secrets as S


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + content


def rsa_like(rng):
    number = lambda k: der(2, b"\x01" + rng.randbytes(k))
    return der(0x30, der(2, b"\0") + b"".join(number(k) for k in (64, 2, 64, 32, 32, 32, 32, 32)))


def b64(x, url=False):
    return (base64.urlsafe_b64encode(x).rstrip(b"=") if url else base64.b64encode(x)).decode()


def jwt(rng, alg="HS256", size=32):
    return ".".join([b64(json.dumps({"alg": alg, "typ": "JWT"}).encode(), True), b64(b'{"sub":"1"}', True), b64(rng.randbytes(size), True)])


def crc_token(rng):
    body = "".join(rng.choice(S._B62) for _ in range(30))
    n, out = binascii.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = S._B62[r] + out
    return "ghp_" + body + out.rjust(6, "0")


def test_confirmed_and_refuted():
    rng = random.Random(1)
    key, hexkey = rsa_like(rng), rng.randbytes(20).hex()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + b64(key) + "\n-----END RSA PRIVATE KEY-----"
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"pub" * 9) + field(b"priv" * 30)
    ssh_pem = "-----BEGIN OPENSSH PRIVATE KEY-----\n" + b64(ssh) + "\n-----END OPENSSH PRIVATE KEY-----"
    access = "AKIA" + base64.b32encode(rng.randbytes(10)).decode()
    good = {pem: "rsa_private_key", ssh_pem: "openssh_private_key", b64(key): "rsa_private_key", jwt(rng): "signed_token", jwt(rng, "RS256", 256): "signed_token", access: "access_key_id", crc_token(rng): "ghp_token", f'token = "{hexkey}"': "hex_key"}
    for text, kind in good.items():
        found = S.find_secrets(f"before {text} after")
        assert [k for k, _, _ in found] == [kind], (text[:40], found)
        k, at, secret = found[0]
        assert f"before {text} after"[at : at + len(secret)] == secret
    token = crc_token(rng)
    bad = [b64(key[:-1] + b"\0\0\0"), b64(b"\x30\x82" + rng.randbytes(80)), jwt(rng, "HS256", 31), jwt(rng, "what", 32), jwt(rng).replace("eyJ", "eyK", 1), token[:-1] + ("a" if token[-1] != "a" else "b"), "AKIA" + "A" * 16, hexkey, 'token = "' + "ab" * 20 + '"', 'key = "' + "thequickbrownfoxjumpsoverthelazydog" + '"', f'key = "{hexkey[:-1]}"', "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----"]
    for text in bad:
        assert S.find_secrets(f"before {text} after") == [], text[:60]


def test_keys_in_any_run():
    rng = random.Random(4)
    curve, ed = der(6, bytes.fromhex("2a8648ce3d030107")), der(6, bytes.fromhex("2b6570"))
    ec = der(0x30, der(2, b"\1") + der(4, rng.randbytes(32)) + der(0xA0, curve) + der(0xA1, der(3, b"\0\4" + rng.randbytes(64))))
    ed = der(0x30, der(2, b"\0") + der(0x30, ed) + der(4, der(4, rng.randbytes(32))))
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"pub" * 9) + field(b"priv" * 30)
    assert len(ec) == 121 and len(ed) == 48
    for key, kind in ((rsa_like(rng), "rsa_private_key"), (ec, "ec_private_key"), (ed, "pkcs8_private_key"), (ssh, "openssh_private_key")):
        for form in (b64(key), b64(key, True), key.hex(), key.hex().upper()):
            for before in ("", "PRIVATE_KEY=", "key: ", 'key = "', "x/MAMI", "0x", "30"):
                if before == "30" and form[:2] not in ("30", "6f", "6F"):
                    continue
                text = f"see {before}{form} after"
                assert S.find_secrets(text) == [(kind, 4 + len(before), form)], (kind, before, form[:20])
        for wrong in (b64(key[:-1]), b64(key + b"\0\0\0"), key.hex()[:-2], key.hex() + "00"):
            assert S.find_secrets(f"see {wrong} after") == [], kind


def test_depth_and_number_of_keys_are_no_limit():
    rng = random.Random(8)
    nested = der(5, b"")
    for _ in range(3000):
        nested = der(0x30, nested)
    ed = der(6, bytes.fromhex("2b6570"))
    deep = der(0x30, der(2, b"\0") + der(0x30, ed) + der(4, rng.randbytes(34)) + der(0xA0, nested))
    assert S.find_secrets(f"see {b64(deep)} after") == [("pkcs8_private_key", 4, b64(deep))]
    field = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (20).to_bytes(4, "big") + field(b"pub" * 9) * 20 + field(b"priv" * 30)
    assert S.find_secrets(f"see {b64(ssh)} after") == [("openssh_private_key", 4, b64(ssh))]
    assert S.openssh_key(ssh[:-1]) is None and S.openssh_key(ssh.replace((20).to_bytes(4, "big"), (2**32 - 1).to_bytes(4, "big"))) is None


def test_token_before_a_full_stop():
    rng = random.Random(6)
    token = jwt(rng)
    for text in (f"use {token}.", f"use {token}. Then", f"({token}.)", f"use {token}..."):
        assert [(k, x) for k, _, x in S.find_secrets(text)] == [("signed_token", token)], text
    assert S.find_secrets(f"use {token}.more") == []


def test_table_against_brute_force(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    want = sorted((d, k, at, len(s), hashlib.sha256(s.encode()).hexdigest()) for d, t in zip(docs.doc_id, docs.text) for k, at, s in S.find_secrets(t))
    assert sorted(map(tuple, S.query(spark, sf).collect())) == want and want


def test_edge_rows(spark):
    rng = random.Random(2)
    secret = f'token = "{rng.randbytes(20).hex()}"'
    rows = [(1, None), (2, ""), (None, secret), (3, secret), (3, secret), (4, "word " * 300_000 + secret), (5, "a" * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as kind")
    got = S.scan(df).collect()
    assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 9), (3, 9), (3, 9), (4, 1_500_009)]
    assert S.scan(df.limit(0)).collect() == []
