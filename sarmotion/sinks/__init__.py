"""Writers: rasters, cubes, tables and metadata sidecars."""
