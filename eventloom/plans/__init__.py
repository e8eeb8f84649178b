"""Registered queries, one module per report family."""
import importlib
import pkgutil


def load():
    """Import every plan module and return the filled registry."""
    from eventloom.plans import registry
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry
