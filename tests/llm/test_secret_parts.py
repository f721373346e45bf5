"""Weak secrets and bare host names with nothing else in the document."""

from cohortloom.llm import secrets

TOKEN = "aB3dE5fG7hJ9" * 3 + "kL1m"


def test_token_and_host():
    for text in (f"connect to db.example.com with {TOKEN}", f"{TOKEN} opens db.example.com:5432 today"):
        at = text.index(TOKEN)
        assert secrets.find_secrets(text) == ([], [("weak_secret", at, at + len(TOKEN))])
    text = f"db.example.com {'x ' * 300} {TOKEN}"
    assert secrets.find_secrets(text)[1] == []
    assert secrets.find_secrets(f"see db.example.com, not {'0' * 3}")[1] == []
