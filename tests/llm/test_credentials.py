"""Key paths, byte offsets, and values put together, with literal expected rows."""

from __future__ import annotations

import pytest

from quarryline.llm import credentials

V = "aB3xQ9zLmN2p"
CASES = [
    ("json", f'{{"secret": {{"value": "{V}"}}}}', [1]),
    ("json", f'{{"passwords": ["{V}", "zz9KqLm82x"]}}', [1]),
    ("json", f'{{"env": [{{"name": "DB_PASSWORD", "value": "{V}"}}, {{"name": "X", "value": "Ab3xQ9zLmN2q"}}]}}', [1]),
    ("json", '{"secret": {"name": "my-secret-12", "sha256": "9f86d081884c7d659a2feaa0"}}', []),
    ("json", '{"integrity": "sha512-6o2Jph3298BbwwQ8uw2txYHHKiGu1hg4dSN9yQSe", "max_tokens": "4096"}', []),
    ("yaml", f"env:\n  - name: DB_PASSWORD\n    value: {V}\n  - name: LOG\n    value: debug\n", [3]),
    ("yaml", f"db: {{user: bob, password: {V}}}\n", [1]),
    ("yaml", f"password: |\n  {V}\nother: 1\n", [2]),
    ("yaml", f"passwords:\n  - {V}\n  - {V}\n", [2, 3]),
    ("yaml", f"secrets:\n  db: {V}\n  name: x1-yB-3cd\n", [2]),
    ("yaml", 'password: "${VAULT_REF}"\npasswd: xxxxxxxx\n', []),
    ("toml", f'db = {{ user = "bob", password = "{V}" }}\n', [1]),
    ("toml", f'tokens = ["{V}"]\n', [1]),
    ("env", f"DB_PASSWORD={V} # note\nSMTP_PASSWORD=changeme-in-deploy\n", [1]),
    ("py", f"x = 1\n# ask ops, db_password : {V}\n# the pwd = value pair is read from the vault\n", [2]),
    ("py", f"run(user='a', pw='{V}')\n", [1]),
    ("ts", f"run({{ user: 'a', pass: '{V}' }});\n", [1]),
    ("py", f'AUTH__TOKEN = "{V}"\ndb2_pass = "{V}"\n', [1, 2]),
    ("py", f"p = 'é'\npassword = '{V}'\n", [2]),
    ("py", "password = os.environ['PASSWORD']\nmax_password_length = '12'\n", []),
]


@pytest.mark.parametrize("kind,text,lines", CASES)
def test_lines(kind, text, lines):
    assert credentials.lines_of(text, kind) == lines


def test_masks_all_parts_and_nothing_else():
    parts = [f"ab3Q{k:05d}" for k in range(500)]
    text = "n = 'äöü €'\npassword = (\n" + "\n".join(f' "{p}"' for p in parts) + "\n)\nx = 'kept'\n"
    got = credentials.masked(text, "py")
    assert not any(p in got for p in parts) and got.startswith("n = 'äöü €'\n") and got.endswith("\n)\nx = 'kept'\n")
    assert got.count(credentials.MASK) == 500


def test_bytes_around_masks_stay(spark):
    for kind, text, lines in CASES:
        got = credentials.masked(text, kind)
        rest = got.encode().split(credentials.MASK.encode())
        assert (len(rest) > 1) == bool(lines)
        at, raw = 0, text.encode()
        for piece in rest:
            at = raw.index(piece, at) + len(piece)


def test_dotenv_variants_are_configuration(spark):
    files = spark.createDataFrame([(1, "app/.env.local"), (2, "a.json"), (3, None)], "file_id long, path string")
    text = spark.createDataFrame([(1, f"DB_PASSWORD={V}\n"), (2, f'{{"password": "{V}"}}'), (3, ""), (4, None)], "file_id long, content string")
    memory = spark.createDataFrame([(1, None), (2, f"the password is {V}.")], "feed_seq long, content string")
    rows = credentials.credential_lines(credentials.texts(files, text, memory)).collect()
    assert sorted(tuple(r) for r in rows) == [("file_text", "1", 1), ("file_text", "2", 1), ("memory_rev", "2", 1)]
