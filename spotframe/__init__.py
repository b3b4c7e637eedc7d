"""spotframe: slide-resolved expression analytics as Spark DataFrame operators.

Data model (all long and sparse, zeros absent):
  expr(sample, barcode, gene, value)              one row per non-zero entry
  spots(sample, barcode, in_tissue, array_row, array_col, x, y, cluster, condition)
  genes(gene_id, gene_name, idx)
  composition(sample, barcode, cell_type, score)
  edges(sample, src, dst, weight)
  lr_db(lr, ligand array<string>, receptor array<string>, pathway)

Every operator is a function DataFrame(s) -> DataFrame; nothing is collected
to the driver except bounded scalars (a median, a count of batches).
"""

__version__ = "0.1.0"
