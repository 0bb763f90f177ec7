"""Fixed job parameters shared by the Spark queries and their oracle SQL."""

TRAINED_AT = "2024-06-03 09:30:00"     # corpus job run time (a parameter, not now())
AS_OF = "2024-02-01 00:00:00"          # change-set apply time
EMBEDDING_MODEL = "hashing-tfidf"
EMBEDDING_DIM = 4096                   # HashingTF buckets of the built-in encoder
MODEL_CHARS = 512                      # characters that the stand-in model takes of a text
TOP_MATCHES = 5                        # postings kept per resume
