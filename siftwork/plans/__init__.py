"""Registered plans. ``load_all`` imports every plan module and returns the registry."""


def load_all():
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.registry")
