from . import catalog, lists, screens, validation, watch  # all but the catalog register their queries in it

__all__ = ["catalog", "lists", "screens", "validation", "watch"]
