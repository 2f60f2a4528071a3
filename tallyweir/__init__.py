"""A Spark-native engine for exact, transactional, self-maintaining relational data."""

from tallyweir.agent import AgentConfig
from tallyweir.database import Database, Result, SQLError
from tallyweir.kv import KeyValue
from tallyweir.model import Model

__all__ = ["AgentConfig", "Database", "KeyValue", "Model", "Result", "SQLError"]
