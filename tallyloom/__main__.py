from tallyloom.pipeline import main

main()
