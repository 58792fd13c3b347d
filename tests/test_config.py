import pytest

from tidelog.sources import config as c

BASE = "stream:\n  id: 1\n  pg_connection:\n    host: localhost\n    port: 5432\n    name: db\n    username: u\n    password: p\n  batch:\n    max_size: 1000\n    max_fill_ms: 1000\nsink:\n  type: memory\n"


@pytest.fixture
def env(tmp_path):
    (tmp_path / "base.yml").write_text(BASE)
    return {"APP_CONFIG_DIR": str(tmp_path)}


def test_precedence(env, tmp_path):
    assert c.load(env).stream.batch.max_size == 1000
    (tmp_path / "prod.json").write_text('{"stream": {"batch": {"max_size": 5}, "pg_connection": {"host": "h"}}}')
    p = c.load(env)
    assert (p.stream.batch.max_size, p.stream.pg_connection.host, p.stream.pg_connection.port) == (5, "h", 5432)
    p = c.load(env | {"APP_STREAM__BATCH__MAX_SIZE": "7", "APP_STREAM__ID": "9"})
    assert (p.stream.batch.max_size, p.stream.id) == (7, 9)
    assert p.stream.redacted().pg_connection.password is None


def test_environment_names():
    assert c.environment({}) == "prod" and c.environment({"APP_ENVIRONMENT": "DEV"}) == "dev"
    with pytest.raises(c.UnknownEnvironment):
        c.environment({"APP_ENVIRONMENT": "moon"})


def test_failures(env, tmp_path):
    with pytest.raises(c.MissingDirectory):
        c.load({"APP_CONFIG_DIR": str(tmp_path / "none")})
    (tmp_path / "e").mkdir()
    with pytest.raises(c.MissingBaseFile):
        c.load({"APP_CONFIG_DIR": str(tmp_path / "e")})
    (tmp_path / "prod.json").write_text("{")
    with pytest.raises(c.BadFormat):
        c.load(env)
    (tmp_path / "prod.json").write_text('{"stream": {"id": "x"}}')
    with pytest.raises(c.BadShape):
        c.load(env)


def test_lists(env):
    raw = c.load_raw(env | {"APP_STREAM__HOSTS": "a,2,true"}, frozenset({"stream.hosts"}))
    assert raw["stream"]["hosts"] == ["a", 2, True]


def test_log_levels():
    import logging

    assert c.set_log_levels({"APP_LOG": "warn,tidelog.test=debug"}) == {"": "WARN", "tidelog.test": "DEBUG"}
    assert logging.getLogger("tidelog.test").level == logging.DEBUG
    assert c.set_log_levels({}) == {"": "INFO"}
    with pytest.raises(c.BadVariable):
        c.set_log_levels({"APP_LOG": "loud"})
    logging.getLogger().setLevel(logging.WARNING)
