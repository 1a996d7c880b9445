from . import best, listing, mails, messages, places, projection, registry, reports, rows, signatures, state, texts, upkeep, workflow

__all__ = ["best", "listing", "mails", "messages", "places", "projection", "registry", "reports", "rows", "signatures", "state", "texts", "upkeep", "workflow"]
