"""The registered queries; importing this package registers them."""

from folia.plans import cases, documents, indexes, relational, retrieval, rules, streams  # noqa: F401
