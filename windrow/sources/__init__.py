from windrow.sources.readers import load_many, load_scada

__all__ = ["load_many", "load_scada"]
